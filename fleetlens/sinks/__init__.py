from fleetlens.sinks.datasets import publish_view, read_dataset, settle, write_csv, write_dataset
from fleetlens.sinks.runs import live, new_run, publish, read_published, read_report, runs_of, unpublished

__all__ = [
    "live",
    "new_run",
    "publish",
    "publish_view",
    "read_dataset",
    "read_published",
    "read_report",
    "runs_of",
    "settle",
    "unpublished",
    "write_csv",
    "write_dataset",
]
