"""Small helpers: the per-window k-means kernel (Python) and native column expressions."""
