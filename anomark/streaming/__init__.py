"""Structured Streaming form of the detector.

Stage A (``stage_a``): N-Triples files, read in order and in bounded micro-batches (``lines``), are parsed and assembled with the
batch operators and appended as one row per event, a folder per batch id. Events may be cut anywhere by files and micro-batches.

Stage B reads these folders one a micro-batch (``batches``), in one of two forms: ``stage_b`` keeps typed state by machine (the last
W events, the warm start of each property) and by reported anomaly, in RocksDB; ``tables`` keeps the same state in tables versioned by
batch id and spreads a machine over tasks. Both write numbered anomalies; ``triple_sink`` writes them as N-Triples text.
"""
