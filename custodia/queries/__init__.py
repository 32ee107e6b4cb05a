"""One query per operator over the given tables, with the SQL it must agree with."""

from custodia.queries import (  # noqa: F401
    bank,
    catalog,
    evidence,
    quality,
    scalars,
    sensitive,
)
from custodia.queries.registry import QUERIES, oracle  # noqa: F401
