"""Secret scans over an incremental ledger of blobs, in DataFrame operations only.

Every historical version of a file is addressed by the SHA-256 of its text.  The ledger holds the pairs of blob and rule
version that have been scanned; only unseen pairs are scanned, once for each distinct text, and the findings are joined
back to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialise, scope, unused


@dataclass(frozen=True)
class Rule:
    """``pattern``: as Java reads it; ``group``: what has to have ``least`` characters; ``gate``: no valid match where this doesn't match."""

    kind: str
    version: int
    pattern: str
    gate: str
    group: int = 0
    least: int = 1


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]%s)"""
#: A run of a character class is found whole whether or not its length is bounded below, so that two of these bound it at once.
BASE = (
    Rule("assign", 1, _ASSIGN % "+", _ASSIGN % "{8,}", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE
_BEGIN = r"-----BEGIN ((?:[A-Z]+ )?)PRIVATE KEY-----"
#: What a key spans: up to the matching END line; else base64 up to the end of the text; else as far as long pieces of base64 go, so that
#: other text after a cut key or a mere mention stays.  Header lines of a key may stand first, and line feeds may be written as ``\\n``.
#: Repeated groups are possessive, which Java matches without recursion.
_GAP, _HEADER = r"(?:\s|\\[nr])", r"(?:Proc-Type|DEK-Info):[^\r\n\\]*+"
_KEY = (
    rf"{_BEGIN}(?:(?:[^-]++|-(?!----))*+-----END \1PRIVATE KEY-----"
    rf"|(?:{_GAP}++{_HEADER})*+(?:(?:{_GAP}|[A-Za-z0-9+/=])*+\z|(?:{_GAP}++[A-Za-z0-9+/=]{{16,}}+)*+(?:{_GAP}++[A-Za-z0-9+/]*+={{1,2}})?))"
)
#: What redaction covers: a finding of ``pem`` in the scan is the key's BEGIN line alone, and here it is the whole key.
REDACTED = tuple(Rule("pem", 2, _KEY, r.gate) if r.kind == "pem" else r for r in RULES)

SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def blob_of(text: Column) -> Column:
    """The address of a text; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _pieces(text: Column, rule: Rule, rank: int) -> Column:
    """The matches of a rule in order: the lengths of each and of what stands before it since the last, in code points."""
    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("g"),
        F.split(text, rule.pattern, -1).alias("p"),
    )
    made = F.transform(
        F.filter(parts, lambda x: x["m"].isNotNull()),
        lambda x, i: F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), i.alias("i"), F.length(x["p"]).cast("bigint").alias("gap"), F.length(x["m"]).cast("bigint").alias("len"), (F.length(x["g"]) >= rule.least).alias("valid")),
    )
    none = F.array().cast("array<struct<rank:int,kind:string,i:int,gap:bigint,len:bigint,valid:boolean>>")
    return F.when(text.rlike(rule.gate), made).otherwise(none)


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings in distinct texts (``blob``, ``text``, ``todo``: rules to apply): ``blob``, ``kind``, ``version``, ``start``, ``end``."""
    pieces = F.concat(*[F.when(F.array_contains("todo", _tag(r)), _pieces(F.col("text"), r, k)).otherwise(F.array()) for k, r in enumerate(rules)])
    rows = blobs.select("blob", F.inline(pieces))
    upto = Window.partitionBy("blob", "rank").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    version = reduce(lambda c, r: c.when(F.col("kind") == r.kind, r.version), rules, F).cast("int")
    return rows.withColumn("end", end).where("valid").select("blob", "kind", version.alias("version"), (F.col("end") - F.col("len")).alias("start"), "end")


def _tag(rule: Rule) -> str:
    return f"{rule.kind}/{rule.version}"


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, found: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan what is new in ``versions`` and join the findings to all of them.

    Returns three tables: the paths (``doc_id``, ``blob``, ``spans``: array of start, rank, kind and end in code points, by
    start and then as the rules are listed), the ledger (``blob``, ``rule`` as ``kind/version``) and the findings (``blob``,
    ``kind``, ``version``, ``start``, ``end``), the latter two with what earlier calls returned.  Null and empty texts have
    no finding; null ids and repeated rows stay as they are; an empty table gives empty ones; other columns aren't read.
    """
    rows = versions.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    paths = rows.select("doc_id", blob_of(F.col("text")).alias("blob"))
    tags = F.array(*[F.lit(_tag(r)) for r in rules])
    pairs = paths.groupBy("blob").agg(F.min("doc_id").alias("rep")).withColumn("todo", tags)
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        pairs = pairs.join(seen, "blob", "left").withColumn("todo", F.array_except("todo", F.coalesce("seen", F.array().cast("array<string>")))).drop("seen")
    pairs = materialise(pairs.where(F.size("todo") > 0))
    # One path stands for each blob; should it hold the blob in several rows, the findings are made distinct below.
    texts = rows.withColumn("blob", blob_of(F.col("text"))).where("text <> ''").join(pairs.withColumnRenamed("blob", "b"), (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = texts.select(F.monotonically_increasing_id().alias("row"), "blob", "text", "todo")
    texts = texts.select(F.struct("row", "blob").alias("blob"), "text", "todo")
    fresh = _scan(texts, rules).select("blob.blob", "kind", "version", "start", "end").distinct()
    found = materialise(fresh if found is None else found.unionByName(fresh))
    done = pairs.select("blob", F.explode("todo").alias("rule"))
    ledger = done if ledger is None else ledger.unionByName(done)

    valid = reduce(lambda c, r: c | ((F.col("kind") == r.kind) & (F.col("version") == r.version)), rules, F.lit(False))
    rank = reduce(lambda c, kr: c.when(F.col("kind") == kr[1].kind, kr[0]), enumerate(rules), F).cast("int")
    # The findings of a text are about as long as the text at most.
    spans = materialise(found.where(valid).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans")))
    out = paths.join(spans, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))
    return out, ledger, found


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(paths: DataFrame) -> DataFrame:
    """Counts of the base kinds and digests of the spans of each path."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    counts = [F.size(F.filter("spans", _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return paths.select("doc_id", *counts, F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each maximal run of covered characters replaced by ``mark``; ``spans`` are sorted by start."""
    keep = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when((s["start"] < a["at"]) & (a["at"] > 0), a["out"]).otherwise(F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))),
    )
    return F.when(F.size(spans) > 0, keep).otherwise(text)


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = REDACTED) -> DataFrame:
    """Every row of ``docs`` with the secrets in ``text`` replaced; all other columns stay as they are.

    Null and empty texts stay, as do null ids and repeated rows; a table may be empty.
    """
    blob, spans = unused(docs, "blob"), unused(docs, "spans")
    with scope() as keep:
        paths, _, _ = scan(docs.select("doc_id", "text"), rules)
        # A written table's size is known, so that Spark sends it to the documents if it is small.
        found = keep(materialise(paths.where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans)).distinct()))
    out = docs.join(found, blob_of(F.col("text")) == F.col(blob), "left")
    text = redact(F.col("text"), F.coalesce(spans, F.array().cast(f"array<{SPAN}>")))
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
