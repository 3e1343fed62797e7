from .bookings import bookings
from .tables import (
    coerce_numeric,
    columns_of,
    export_csv,
    export_parquet,
    load_table,
    reconcile,
    staged,
    work_folder,
)

__all__ = [
    "bookings",
    "coerce_numeric",
    "columns_of",
    "export_csv",
    "export_parquet",
    "load_table",
    "reconcile",
    "staged",
    "work_folder",
]
