"""The queries of this package; importing the modules registers them."""

from valora.llm import (  # noqa: F401
    collocations, decontaminate, filter_audit, language_id, license_scan, mixing, nearest, quality, quality_rules, sharding,
    simhash, suffix_dedup, url_filter,
)
from valora.llm.common import ORACLE, REGISTRY

__all__ = ["ORACLE", "REGISTRY"]
