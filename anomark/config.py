"""Frozen configuration shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values of the detection method (window, chain length) and of the
# k-means convergence test. They must equal the original method's to reproduce its results.
DEFAULT_WINDOW_SIZE = 10
DEFAULT_NUM_TRANSITIONS = 5
DEFAULT_KMEANS_TOL = 1e-5


@dataclass(frozen=True)
class DetectorConfig:
    """Knobs of the detector.

    window_size      W, events per machine window (count window, slide 1)
    num_transitions  N, transitions per chain
    kmeans_tol       stop when the mean distance changes by at most this much
    lag              1: a window is evaluated when the machine's next event arrives, so the
                     last full window of a machine is never evaluated; 0: every full window
    tail             'none' | 'reference' (also evaluate the stream's last machine's last
                     window, full or short) | 'file' (the stream's last event is never
                     dispatched)
    assembly_mode    'by_edges' (order-free joins) | 'by_position' (file-order parity)
    properties       allow-list of property ids to cluster; empty = all stateful ones
    system_uri       base IRI of the anomaly and timestamp resources in the output triples
    fold_chunk_events   windows and the warm-start fold of a (machine, property) are cut into
                     runs of this many events, processed in parallel and then made exact by
                     fix-up rounds (``anomark.operators.fold``); None = one run per key
    """

    window_size: int = DEFAULT_WINDOW_SIZE
    num_transitions: int = DEFAULT_NUM_TRANSITIONS
    kmeans_tol: float = DEFAULT_KMEANS_TOL
    lag: int = 1
    tail: str = "none"
    assembly_mode: str = "by_edges"
    properties: tuple[str, ...] = field(default_factory=tuple)
    system_uri: str = "http://example.org/anomark"
    fold_chunk_events: int | None = 1 << 16

    def __post_init__(self) -> None:
        if self.window_size < 1:
            raise ValueError("window_size must be >= 1")
        if self.num_transitions < 0:
            raise ValueError("num_transitions must be >= 0")
        if self.lag not in (0, 1):
            raise ValueError("lag must be 0 or 1")
        if self.tail not in ("none", "reference", "file"):
            raise ValueError("tail must be 'none', 'reference' or 'file'")
        if self.tail != "none" and self.lag == 0:
            raise ValueError("with lag 0 every full window is evaluated at once: there is no tail to flush")
        if self.fold_chunk_events is not None and self.fold_chunk_events < self.window_size:
            raise ValueError("fold_chunk_events must be at least window_size")
        if self.assembly_mode not in ("by_edges", "by_position"):
            raise ValueError("assembly_mode must be 'by_edges' or 'by_position'")

    def with_(self, **changes) -> "DetectorConfig":
        return replace(self, **changes)
