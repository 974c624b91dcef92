"""lipika: a PySpark-native engine for multilingual corpora and per-script tokenizers."""

__version__ = "0.1.0"

from .model import TokenizerModel  # noqa: E402
from .operators.segment import runs, with_runs  # noqa: E402
from .operators.slots import DEFAULT_SPECS, SlotSpec, allocate, layout, validate  # noqa: E402

__all__ = ["DEFAULT_SPECS", "SlotSpec", "TokenizerModel", "allocate", "layout", "runs", "validate", "with_runs"]
