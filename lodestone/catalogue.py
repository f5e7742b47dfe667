"""All queries of the library but those of the training-data subpackage."""

from lodestone.queries import REGISTRY

QUERIES = {name: q.run for name, q in REGISTRY.items()}
ORACLE_SQL = {name: q.oracle for name, q in REGISTRY.items() if q.oracle}
