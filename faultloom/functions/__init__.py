from .columns import (
    DEFAULT_BANDS,
    band,
    class_imbalance,
    classify,
    epoch_micros,
    fuse,
    is_fault,
    label_name,
    nan_to_null,
    percentage,
    ratio,
    signed_log,
)

__all__ = [
    "DEFAULT_BANDS",
    "band",
    "class_imbalance",
    "classify",
    "epoch_micros",
    "fuse",
    "is_fault",
    "label_name",
    "nan_to_null",
    "percentage",
    "ratio",
    "signed_log",
]
