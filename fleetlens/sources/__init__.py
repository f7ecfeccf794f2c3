from fleetlens.sources.catalogue import catalogue_frame, pair_members, read_name_list, read_sensor_names
from fleetlens.sources.csv_files import read_csv, read_csv_checked, read_indexed_csv
from fleetlens.sources.tables import Fleet

__all__ = [
    "Fleet",
    "catalogue_frame",
    "pair_members",
    "read_csv",
    "read_csv_checked",
    "read_indexed_csv",
    "read_name_list",
    "read_sensor_names",
]
