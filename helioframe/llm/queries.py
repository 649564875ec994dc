"""The registered queries of this subpackage: one thin query for each operator, with production parameters over the whole table."""

from __future__ import annotations

from helioframe.llm import decontaminate, fixity, lines, mixing, oracles, quality, rules, simhash, suffixes, tokens, toxicity
from helioframe.llm.common import table

QUERIES = {
    "op1_lines": lambda spark, sf: lines.digest(table(spark, sf, "documents")),
    "op2_suffixes": lambda spark, sf: suffixes.digest(table(spark, sf, "documents")),
    "op3_quality": lambda spark, sf: quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op4_toxicity": lambda spark, sf: toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op5_fixity": lambda spark, sf: fixity.digest(table(spark, sf, "pages")),
    "op6_tokens": lambda spark, sf: tokens.digest(table(spark, sf, "documents")),
    "op7_rules": lambda spark, sf: rules.digest(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op8_mixing": lambda spark, sf: mixing.digest(table(spark, sf, "documents")),
    "op9_decontaminate": lambda spark, sf: decontaminate.digest(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op10_simhash": lambda spark, sf: simhash.near_duplicates(table(spark, sf, "documents")),
}

ORACLE_SQL = {"op5_fixity": fixity.ORACLE, "op8_mixing": mixing.ORACLE, **oracles.ORACLE_SQL}
