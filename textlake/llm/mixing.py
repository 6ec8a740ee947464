"""Mixing sources to target weights: iterative proportional fitting (raking).

Documents fall into cells (source, language, topic).  Every value without a
target of its own counts as ``*``, so the cells are at most the product of the
target lists' lengths, whatever the table holds; Spark sums documents and
tokens per cell, and only this bounded table comes to the driver.  There the
token weights are raked: scaled to the source targets, then to the language
targets, then to the topic targets, ``rounds`` times over.  The weights add up
to ``budget`` times all tokens, and a cell's weight never exceeds its tokens, so
its calibrated probability (weight over tokens) is at most 1 and no document is
needed twice; the sample meets the targets in expectation, as far as they can
be met together within the budget.  A document stays if a
hash of its id, as a number in [0, 1), is below the probability of its cell.

Defined results
* null source, language or topic: the value ``*``; null or empty text: no tokens;
* a target value that has no tokens is left out and the others are scaled up;
  a cell without tokens has probability 1, its documents cost nothing;
* repeated rows (same id; without an id, same text) stay or go together; extra columns are kept;
* an empty table gives an empty result.
"""

from __future__ import annotations

from typing import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.operators.common import hash_share

Targets = Mapping[str, Mapping[str, float]]

#: Shares of tokens wanted by the registered query and the pipeline.
TARGETS: Targets = {
    "source": {"src0": 0.30, "*": 0.70},
    "lang": {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.12, "*": 0.01},
    "topic": {"legal": 0.03, "contact": 0.02, "numeric": 0.04, "long": 0.66, "short": 0.24, "*": 0.01},
}
BUDGET = 0.8
ROUNDS = 20
SEED = 17

#: Topic by what a text holds, first rule that fits: (name, pattern); texts that
#: fit none are long or short by LONG_WORDS.
TOPIC_RULES = (("legal", r"(?i)licen[cs]e|copyright|rights reserved"), ("contact", "@"), ("numeric", "[0-9]{4}"))
LONG_WORDS = 300
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """Rule-made topic for tables that have no topic column."""
    out = None
    for name, pattern in TOPIC_RULES:
        out = (F.when if out is None else out.when)(text.rlike(pattern), name)
    return out.when(tokens >= LONG_WORDS, "long").otherwise("short")


def _listed(value: Column, target: Mapping[str, float]) -> Column:
    names = [n for n in target if n != "*"]
    return F.when(value.isin(names), value).otherwise("*") if names else F.lit("*")


def rake(tokens: np.ndarray, cells: list[tuple], targets: list[Mapping[str, float]],
         budget: float = BUDGET, rounds: int = ROUNDS) -> np.ndarray:
    """Raked token weights of the cells."""
    w = tokens * budget
    goal = tokens.sum() * budget
    for _ in range(rounds):
        for k, target in enumerate(targets):
            keys = np.array([c[k] for c in cells])
            names = sorted(set(keys[tokens > 0]))
            total = sum(target.get(n, 0.0) for n in names)
            for n in names if total else ():
                own = keys == n
                now = w[own].sum()
                factor = target.get(n, 0.0) / total * goal / now if now else 0.0
                w[own] = np.minimum(tokens[own], w[own] * factor)
    return w


def probabilities(tokens: np.ndarray, cells: list[tuple], targets: list[Mapping[str, float]],
                  budget: float = BUDGET, rounds: int = ROUNDS) -> np.ndarray:
    """Calibrated sampling probabilities of the cells."""
    w = rake(tokens, cells, targets, budget, rounds)
    return np.divide(w, tokens, out=np.ones(len(w)), where=tokens > 0)


def sample(docs: DataFrame, targets: Targets = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS, seed: int = SEED,
           doc_id: str = "doc_id", text: str = "text", prefix: str = "mix_") -> DataFrame:
    """``docs`` with the columns ``mix_tokens``, one ``mix_<dimension>`` a dimension,
    ``mix_probability`` and ``mix_kept`` (columns of these names are replaced).  A dimension is a column of ``docs``;
    ``topic`` is made by rule where there is no such column."""
    if any("*" not in t for t in targets.values()):
        raise ValueError("every target list needs the value *")
    missing = [d for d in targets if d not in docs.columns and d != "topic"]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    frame = docs.withColumn(f"{prefix}tokens", n_tokens(F.col(text)))
    names = []
    for dim, target in targets.items():
        value = F.col(dim) if dim in docs.columns else topic(F.col(text), F.col(f"{prefix}tokens"))
        names.append(f"{prefix}{dim}")
        frame = frame.withColumn(names[-1], _listed(value, target))
    # at most prod(len(target)) rows
    cells = frame.groupBy(*names).agg(F.sum(f"{prefix}tokens").alias("t")).orderBy(*names).collect()
    keys = [tuple(c[n] for n in names) for c in cells]
    p = probabilities(np.array([c["t"] for c in cells], float), keys, list(targets.values()), budget, rounds)
    schema = ", ".join(f"`{n}` string" for n in names) + f", `{prefix}probability` double"
    known = docs.sparkSession.createDataFrame([(*k, float(x)) for k, x in zip(keys, p)], schema)
    frame = frame.join(F.broadcast(known), names)
    unit = hash_share(seed, F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text)), F.lit("")))
    return frame.withColumn(f"{prefix}kept", unit < F.col(f"{prefix}probability"))


def mix(docs: DataFrame, targets: Targets = TARGETS, **params) -> DataFrame:
    """The sampled documents, with their columns and ``mix_probability``."""
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    frame = sample(docs, targets, prefix=prefix, **params)
    columns = [c for c in docs.columns if c != "mix_probability"]
    return frame.filter(F.col(f"{prefix}kept")).select(
        *[F.col(f"`{c}`") for c in columns], F.col(f"{prefix}probability").alias("mix_probability"))


def _sql_case(column: str, target: Mapping[str, float]) -> str:
    names = ", ".join(f"'{n}'" for n in target if n != "*")
    return f"CASE WHEN {column} IN ({names}) THEN {column} ELSE '*' END"


def sample_sql(targets: Targets = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same as DuckDB SQL over ``documents``: the raking is a chain of window sums."""
    topic_sql = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPIC_RULES)
    topic_sql += f" WHEN n_tokens >= {LONG_WORDS} THEN 'long' ELSE 'short' END"
    steps = f"SELECT *, t * {budget} AS w, sum(t) OVER () * {budget} AS goal FROM cells WHERE t > 0"
    wanted = {d: f"(SELECT target FROM tg_{d} g WHERE g.name = {d})" for d in targets}
    for _ in range(rounds):
        for d in targets:
            steps = (f"SELECT * EXCLUDE (w), least(t, w * (share_{d} * goal / sum(w) OVER (PARTITION BY {d}))) AS w "
                     f"FROM ({steps})")
    shares = ", ".join(f"{wanted[d]} AS share_{d}" for d in targets)
    lists = []
    for d, target in targets.items():
        rows = ", ".join(f"('{n}', {float(v)!r}::DOUBLE)" for n, v in target.items())
        lists.append(f"""tg_{d} AS (SELECT name, v / sum(v) OVER () AS target FROM (VALUES {rows}) x(name, v)
            WHERE name IN (SELECT {d} FROM sums WHERE t > 0))""")
    dims = ", ".join(targets)
    return f"""
WITH d0 AS (SELECT doc_id, text, source AS source0, lang AS lang0,
                   len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens FROM documents),
d1 AS (SELECT doc_id, n_tokens, {_sql_case('source0', targets['source'])} AS source,
              {_sql_case('lang0', targets['lang'])} AS lang, {topic_sql} AS topic FROM d0),
sums AS (SELECT {dims}, CAST(sum(n_tokens) AS DOUBLE) AS t FROM d1 GROUP BY {dims}),
{", ".join(lists)},
cells AS (SELECT *, {shares} FROM sums),
raked AS MATERIALIZED ({steps}),
p AS (SELECT {dims}, w / t AS probability FROM raked)
SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, source, lang, topic, round(coalesce(probability, 1.0), 9) AS probability,
       CAST('0x' || substr(md5('{seed}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0
           < coalesce(probability, 1.0) AS kept
FROM d1 LEFT JOIN p USING ({dims})"""
