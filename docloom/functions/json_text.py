"""JSON as text: canonical form, repeated keys and depth, which from_json does not tell."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _depth(value) -> int:
    if isinstance(value, dict):
        return 1 + max(map(_depth, value.values()), default=0)
    return 1 + max(map(_depth, value), default=0) if isinstance(value, list) else 0


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Keys sorted, no white space, whole numbers without a point; null for what is not JSON."""

    def one(text):
        try:
            plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else int(v) if isinstance(v, float) and v.is_integer() else v
            return json.dumps(plain(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(one)


@F.pandas_udf(T.StructType().add("repeated", T.ArrayType(T.StringType())).add("depth", T.IntegerType()))
def json_facts(texts: pd.Series) -> pd.DataFrame:
    """Keys that some object has twice, and the nesting depth; both null for what is not JSON."""

    def one(text):
        twice: list[str] = []

        def pairs(items):
            seen = set()
            for k, _ in items:
                if k in seen:
                    twice.append(k)
                seen.add(k)
            return dict(items)

        try:
            return sorted(set(twice)), _depth(json.loads(text, object_pairs_hook=pairs)), sorted(set(twice))
        except (TypeError, ValueError, RecursionError):
            return None, None, None

    found = texts.map(one)
    return pd.DataFrame({"repeated": found.map(lambda f: f[2]), "depth": found.map(lambda f: f[1]).astype("Int32")})


def self_hash(body: Column) -> Column:
    """SHA-256 of the canonical JSON of a struct or map."""
    return F.sha2(canonical_json(F.to_json(body, {"ignoreNullFields": "false"})), 256)


def metadata_verdict(text: Column | str, most_bytes: int = 4096, most_depth: int = 4) -> Column:
    """ok, or why a metadata text is refused: too-large, not-json, repeated-key or too-deep. Nothing is cut."""
    text = F.col(text) if isinstance(text, str) else text
    facts = json_facts(text)
    return (
        F.when(F.octet_length(text) > most_bytes, "too-large").when(facts["depth"].isNull(), "not-json")
        .when(F.size(facts["repeated"]) > 0, "repeated-key").when(facts["depth"] > most_depth, "too-deep").otherwise("ok")
    )
