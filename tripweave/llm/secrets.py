"""Secrets in texts, told apart from copied examples by who owns them in the corpus.

A scan finds candidate spans. The hash of every candidate's value is counted over distinct repositories and owners: what many
owners share is an example that was copied around, what stays with one or two looks live. Candidates of the base kinds
are always reported; those of the further kinds, which also match harmless strings, only if their ownership looks live. Both
counts decide: many owners, or very many documents of one owner, make an example.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.llm.common import arrow_schema, map_texts, stored, text_batches, with_row_number

#: Base kinds, in the order that breaks ties of a start.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "private_key", "web_token", "prefixed", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")
_WEB_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "sk_live_")
_PREFIXED = re.compile(f"(?:{'|'.join(_PREFIXES)})[A-Za-z0-9_-]{{16,}}")
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}")


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """``(kind number, start, end, value)`` in code points, by start and kind.

    Per kind leftmost matches that do not overlap; those too short are dropped after matching. Further kinds are left out
    where a base span overlaps them.
    """
    found: list[tuple[int, int, int, str]] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    # The runs of at least 24 are the long ones among all runs.
    found += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    more: list[list[tuple[int, int, int, str]]] = []
    if "PRIVATE KEY-----" in text:
        more.append([(3, m.start(), m.end(), m[0]) for m in _PRIVATE_KEY.finditer(text)])
    if "eyJ" in text:
        more.append([(4, m.start(), m.end(), m[0]) for m in _WEB_TOKEN.finditer(text)])
    if any(p in text for p in _PREFIXES):
        more.append([(5, m.start(), m.end(), m[0]) for m in _PREFIXED.finditer(text)])
    more.append([(6, m.start(), m.end(), m[0]) for m in _RANDOM.finditer(text) if _looks_random(m[0])])
    taken = sorted((a, b) for _, a, b, _ in found)
    for spans in filter(None, more):
        new = _apart(spans, taken)
        found += new
        taken = sorted(taken + [(a, b) for _, a, b, _ in new])
    found.sort(key=lambda x: (x[1], x[0]))
    return found


def _looks_random(v: str) -> bool:
    return len(set(v)) >= 16 and v.upper() != v and v.lower() != v and any(c.isdigit() for c in v)


def _apart(spans: list[tuple[int, int, int, str]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int, str]]:
    """The spans that overlap none of those taken; both ascending, the former without overlaps."""
    out, at, reach = [], 0, 0
    for x in spans:
        # How far reaches what begins before the end of this span?
        while at < len(taken) and taken[at][0] < x[2]:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= x[1]:
            out.append(x)
    return out


_FOUND = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.BinaryType()), T.StructField("varied", T.BooleanType())])
)


def scan(docs: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` inside a struct ``doc``, a ``row`` number, and ``found``: the candidates of the whole text."""
    kept = list(docs.columns if keep is None else keep)
    names = kept if text_col in kept else [*kept, text_col]
    at, own = names.index(text_col), range(len(kept))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc", T.StructType([docs.schema[c] for c in kept])), T.StructField("found", _FOUND)])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        with_texts = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(at)], names=["doc", "text"]) for b in batches)
        for batch, texts in text_batches(with_texts):
            found = [
                [{"kind": KINDS[k], "start": a, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).digest(), "varied": len(set(v)) >= 6} for k, a, b, v in candidates(t)]
                for t in texts
            ]
            fields = batch.column(0).flatten()
            doc = pa.StructArray.from_arrays([fields[i].cast(arrow.field("doc").type.field(i).type) for i in own], fields=list(arrow.field("doc").type))
            yield pa.RecordBatch.from_arrays([with_row_number(part, seen, len(found)), doc, pa.array(found, arrow.field("found").type)], schema=arrow)
            seen += len(found)

    return map_texts(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc")), run, schema)


def ownership(found: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """``value``, ``owners``, ``repos``: how many distinct owners and repositories hold a candidate's value.

    Distinct rows are made before counting, so a value with a third of all rows is combined in every task first. A null
    owner or repository counts as one.
    """
    held = found.select(F.explode("found.value").alias("value"), owner.alias("owner"), repo.alias("repo")).distinct()
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def find_secrets(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", text_col: str = "text", example_owners: int = 3, example_repos: int = 20, keep: Sequence[str] | None = None) -> DataFrame:
    """``doc`` (the row of ``docs``, or its columns ``keep``) and ``secrets``: (kind, start, end, owners, repos, live) by start and kind.

    A span is live if its value varies (6 different characters), fewer than ``example_owners`` owners and fewer than ``example_repos`` repositories have it. Base
    kinds are listed either way, further kinds if live. Null and empty texts have none; repeated rows count once for ownership; an empty
    table gives no rows.
    """
    if keep is not None and text_col not in keep:
        # Without texts all rows are narrow: one scan.
        scanned = stored(scan(docs, text_col, [*keep, *(c for c in (owner_col, repo_col) if c not in keep)]), "scanned")
        hits, clean = scanned.filter(F.size("found") > 0), scanned.filter(F.size("found") == 0)
    else:
        # Few texts have candidates: only those are stored; the others pass by in a scan of their own.
        hits, clean = stored(scan(docs, text_col, keep).filter(F.size("found") > 0), "hits"), scan(docs, text_col, keep).filter(F.size("found") == 0)
    owned = ownership(hits, F.col(f"doc.`{owner_col}`"), F.col(f"doc.`{repo_col}`"))
    spans = hits.select("row", F.posexplode("found").alias("at", "f")).select("row", "at", "f.*").join(owned, "value")
    live = F.col("varied") & (F.col("owners") < example_owners) & (F.col("repos") < example_repos)
    listed = (
        spans.withColumn("live", live)
        .filter(F.col("live") | F.col("kind").isin(*BASE))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("at", "kind", "start", "end", "owners", "repos", "live"))).alias("s"))
        .select("row", F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["owners"].alias("owners"), x["repos"].alias("repos"), x["live"].alias("live"))).alias("secrets"))
    )
    none = F.array().cast(listed.schema["secrets"].dataType)
    with_hits = hits.select("row", "doc").join(listed, "row", "left").select("doc", F.coalesce("secrets", none).alias("secrets"))
    return with_hits.unionByName(clean.select("doc", none.alias("secrets")))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", live: str = "<secret>", example: str = "<example>") -> DataFrame:
    """The documents with every reported span replaced, by ``live`` or ``example``; overlapping spans become one.

    All rows and columns are kept; ``length_col``, if the table has it, follows the text. Null texts stay null.
    """
    found, schema = find_secrets(docs, owner_col, repo_col, text_col), docs.schema
    arrow, at, length_at = arrow_schema(schema), docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else None

    def masked(text: str, spans: list[dict]) -> str:
        merged: list[list] = []
        for s in spans:
            if merged and s["start"] < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s["end"])
                merged[-1][2] |= s["live"]
            else:
                merged.append([s["start"], s["end"], s["live"]])
        out, begin = [], 0
        for a, b, is_live in merged:
            out += [text[begin:a], live if is_live else example]
            begin = b
        return "".join([*out, text[begin:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.cast(f.type) for c, f in zip(batch.column(0).flatten(), arrow, strict=True)]
            texts = [masked(t, s) for t, s in zip(columns[at].to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns[at] = pa.array(texts, arrow[at].type)
            if length_at is not None:
                columns[length_at] = pa.array([len(t) for t in texts], pa.int64()).cast(arrow[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    clean = found.filter(F.size("secrets") == 0).select("doc.*")
    return map_texts(found.filter(F.size("secrets") > 0), run, schema).unionByName(clean)
