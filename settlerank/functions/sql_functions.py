"""The same rules as functions of SQL: registered in a session, with SQL bodies that the optimizer inlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from settlerank.fixed_values import FAMILY_RULES, FULL_STREAK_LABEL, MISSING_TOKENS, SHORT_STREAK_LABEL, UNKNOWN


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions(rules: Sequence[tuple[str, str]] = FAMILY_RULES) -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, type, body)."""
    missing = ", ".join(_text(t) for t in MISSING_TOKENS)
    family = " ".join(f"WHEN contains(name, {_text(part)}) THEN {_text(token)}" for part, token in rules)
    short = _text(SHORT_STREAK_LABEL)
    return {
        "settle_business_id": ("business STRING", "STRING", r"regexp_replace(business, '\\.0$', '')"),
        "settle_text": ("value STRING", "STRING", f"CASE WHEN value NOT IN ({missing}) THEN value END"),
        "settle_number": ("value STRING", "DOUBLE", f"""CASE WHEN NOT isnan(try_cast(trim(CASE WHEN value NOT IN ({missing}) THEN value END) AS DOUBLE))
            THEN try_cast(trim(CASE WHEN value NOT IN ({missing}) THEN value END) AS DOUBLE) END"""),
        "settle_family": ("business STRING, name STRING", "STRING", f"coalesce(CASE {family} END, business)"),
        "settle_segment": ("a STRING, b STRING, c STRING", "STRING",
                           f"concat_ws('|', coalesce(a, {_text(UNKNOWN)}), coalesce(b, {_text(UNKNOWN)}), coalesce(c, {_text(UNKNOWN)}))"),
        "settle_capacity_penalty": ("over_mbps DOUBLE, upper_mbps DOUBLE", "DOUBLE",
                                    "CASE WHEN upper_mbps > 0 THEN CASE WHEN over_mbps IS NULL THEN 0D ELSE least(1D, over_mbps / upper_mbps) END ELSE 0D END"),
        "settle_streak_label": ("days INT", "STRING", f"CASE WHEN days >= 7 THEN {_text(FULL_STREAK_LABEL)} WHEN days > 0 THEN format_string({short}, days) END"),
        "settle_label": ("name STRING, id STRING, most INT", "STRING", """CASE WHEN length(trim(concat_ws(' ', coalesce(name, ''), id))) > most
            THEN concat(substring(trim(concat_ws(' ', coalesce(name, ''), id)), 1, most), '…') ELSE trim(concat_ws(' ', coalesce(name, ''), id)) END"""),
    }


def register_functions(spark: SparkSession, rules: Sequence[tuple[str, str]] = FAMILY_RULES) -> list[str]:
    """Make the functions callable from ``spark.sql`` of this session; their names."""
    found = definitions(rules)
    for name, (parameters, kind, body) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(found)
