"""DataFrame -> DataFrame operators of the detector."""
