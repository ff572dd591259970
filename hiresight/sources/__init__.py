from .tables import JobTables, read_table, read_optional, find_column, with_defaults  # noqa: F401
from .fixtures import driver_tables  # noqa: F401
