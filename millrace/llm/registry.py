"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .binary import op9_token_files
from .exact import OP10_SQL, op10_exact_dedup
from .licenses import op4_license_scan
from .lines import OP8_SQL, op8_line_dedup
from .mixing import OP6_SQL, op6_pareto_mix
from .packing import op7_packing
from .quality import op5_quality
from .simhash import op3_simhash_groups
from .topk import OP1_SQL, op1_exact_topk
from .urls import OP2_SQL, op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_topk, op2_url_filter, op3_simhash_groups, op4_license_scan, op5_quality, op6_pareto_mix, op7_packing, op8_line_dedup, op9_token_files, op10_exact_dedup)
}
SQL = {"op1_exact_topk": OP1_SQL, "op2_url_filter": OP2_SQL, "op6_pareto_mix": OP6_SQL, "op8_line_dedup": OP8_SQL, "op10_exact_dedup": OP10_SQL}
