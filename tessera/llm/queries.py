"""The queries of this subpackage, and their DuckDB counterparts where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, secrets, stamps, urlfilter
from .langid import op1_language_id
from .licenses import op10_license_scan
from .media import op4_media_columns
from .mixing import op6_source_mix
from .neighbours import op2_nearest
from .packing import op9_best_fit_packing
from .secrets import op5_secret_scan
from .simhash import op8_simhash
from .spelling import op11_spelling
from .stamps import op12_stamps
from .suffixes import op13_suffix_dedup
from .tokencount import op3_token_counts
from .urlfilter import op7_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_nearest": op2_nearest,
    "op3_token_counts": op3_token_counts,
    "op4_media_columns": op4_media_columns,
    "op5_secret_scan": op5_secret_scan,
    "op6_source_mix": op6_source_mix,
    "op7_url_filter": op7_url_filter,
    "op8_simhash": op8_simhash,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_license_scan": op10_license_scan,
    "op11_spelling": op11_spelling,
    "op12_stamps": op12_stamps,
    "op13_suffix_dedup": op13_suffix_dedup,
}
ORACLES: dict[str, str] = {"op10_license_scan": licenses.ORACLE, "op12_stamps": stamps.ORACLE, "op5_secret_scan": secrets.ORACLE, "op7_url_filter": urlfilter.ORACLE}
