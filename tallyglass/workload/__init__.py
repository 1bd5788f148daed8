"""Every operator as a registered query over the given tables."""

from tallyglass.workload import commerce, corpora, evaluation, governance, warehouse  # noqa: F401
from tallyglass.workload.registry import QUERIES, TWINS  # noqa: F401
