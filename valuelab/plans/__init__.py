from .layout import Layout
from .prepare import (
    TrainFacts,
    basket,
    enriched,
    imputed,
    model_table,
    prepare,
    service_rows,
    split_table,
    train_facts,
    typed,
    write_datasets,
)

__all__ = [
    "Layout",
    "TrainFacts",
    "basket",
    "enriched",
    "imputed",
    "model_table",
    "prepare",
    "service_rows",
    "split_table",
    "train_facts",
    "typed",
    "write_datasets",
]
