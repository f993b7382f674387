"""Secret scan with multipart credential linking, with DataFrame functions only.

Base findings are regular-expression matches (assignments, access keys, hex runs). Their positions come from
the lengths of the text pieces between the matches, as running sums over arrays, made in blocks so
that the cost stays near linear in the number of matches.

The method adds weak candidates: client identifiers, bare tokens and endpoints, too common to be
reported alone. The parts of a document are interval-joined: two parts are linked if at most
``SCOPE`` code points lie between them. Each part is dealt to the bin of its start, identifiers and
endpoints also to the neighbouring bins, so the join is an equality on (document, bin) with a
bounded number of partners. A bare token is reported next to an identifier, a client identifier next
to a secret, an endpoint next to both an identifier and a secret.

Defined results: a null text is empty; each row gives a row, also if ids are null or repeated.
Positions are code points, ends exclusive. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import staged

SCOPE = 256
#: In the order in which findings of one start are listed.
KINDS = ["assign", "access", "hex", "client_id", "token", "endpoint"]
_BASE = KINDS[:3]

# The base patterns and the least length of a match (of group 2 for assignments).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LEAST = {"assign": 12, "access": 18, "hex": 16}

# Weak parts.
CLIENT_ID = r"""(?i)(?:client|account|access_?key|user)_?id["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}={0,2}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?"
_IDENTIFIERS, _SECRETS = ["access", "client_id"], ["assign", "hex", "token"]
_SUM_BLOCK = 512


def _sums(x: Column) -> Column:
    """array<long> of the sums from 0 to all elements, one more than the array has."""
    return F.aggregate(x, F.array(F.lit(0).cast("long")),
                       lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def running(x: Column) -> Column:
    """Sum of the elements before each element, block by block."""
    block = F.lit(_SUM_BLOCK)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(x) / block).cast("int") - 1)),
                         lambda b: _sums(F.slice(x, b * block + 1, block)))
    before = _sums(F.transform(blocks, lambda s: F.element_at(s, -1)))
    return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)),
                                lambda s, o: F.transform(F.slice(s, 1, F.size(s) - 1), lambda v: v + o)))


_SPAN = "struct<start:bigint,kind:int,end:bigint>"


def spans(text: Column, kind: str, pattern: str, least: int = 0, group: int = 0) -> Column:
    """array of (start, kind, end) of the matches whose ``group`` has ``least`` characters."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    between = F.transform(F.split(text, pattern, -1), lambda s: F.length(s).cast("long"))
    both = F.zip_with(F.slice(between, 1, F.size(match)), match, lambda s, m: s + F.length(m))
    found = F.transform(
        F.arrays_zip(running(both).alias("before"), F.slice(between, 1, F.size(match)).alias("gap"), match.alias("match"), value.alias("value")),
        lambda z: F.struct((z["before"] + z["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                           (z["before"] + z["gap"] + F.length(z["match"])).alias("end"), F.length(z["value"]).alias("n")))
    kept = F.transform(F.filter(found, lambda z: z["n"] >= least),
                       lambda z: F.struct(z["start"].alias("start"), z["kind"].alias("kind"), z["end"].alias("end")))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    return F.when(text.rlike(pattern), kept).otherwise(none)


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Interval join of the ``parts`` (row, start, kind, end): the weak ones that have their
    complements within ``scope``."""
    code = {k: i for i, k in enumerate(KINDS)}
    of = lambda kinds: F.col("kind").isin([code[k] for k in kinds])
    # A bin is at least as wide as the scope and a part's reach beyond its start is cut into bins.
    first, last = F.expr(f"start div {scope}"), F.expr(f"end div {scope}")
    placed = parts.withColumn("bin", F.explode(F.sequence(first, last)))
    near = parts.withColumn("bin", F.explode(F.sequence(first - 1, last + 1))).select("row", "bin", F.col("start").alias("s"), F.col("end").alias("e"), "kind")
    within = (F.col("start") - F.col("e") <= scope) & (F.col("s") - F.col("end") <= scope)

    def beside(left: DataFrame, kinds: list[str]) -> DataFrame:
        return left.alias("a").join(near.where(of(kinds)).drop("kind").alias("b"),
                                    (F.col("a.row") == F.col("b.row")) & (F.col("a.bin") == F.col("b.bin")) & within, "left_semi")

    tokens = beside(placed.where(of(["token"])), _IDENTIFIERS)
    clients = beside(placed.where(of(["client_id"])), _SECRETS)
    key = ["row", "start", "kind", "end"]
    ends = placed.where(of(["endpoint"]))
    with_id, with_secret = (beside(ends, kinds).select(*key).distinct() for kinds in (_IDENTIFIERS, _SECRETS))
    return tokens.unionByName(clients).select(*key).distinct().unionByName(with_id.intersect(with_secret))


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, base (array of spans), linked (array of
    the weak spans reported), spans (all of them as text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scanned = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"),
        spans(text, "assign", ASSIGN, LEAST["assign"], 2).alias("assign"), spans(text, "access", ACCESS, LEAST["access"]).alias("access"),
        spans(text, "hex", HEX, LEAST["hex"]).alias("hex"),
        F.concat(spans(text, "client_id", CLIENT_ID), spans(text, "token", TOKEN), spans(text, "endpoint", ENDPOINT)).alias("weak"))
    scanned = staged(scanned, "secret-parts")  # the row numbers are given once
    parts = scanned.where(F.size("weak") > 0).select("row", F.explode(F.concat("assign", "access", "hex", "weak")).alias("p")).select("row", "p.*")
    linked = link_parts(parts, scope).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    base = F.concat("assign", "access", "hex")
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    return (scanned.join(linked, "row", "left").withColumn("linked", F.coalesce("linked", none))
            .select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in _BASE],
                    F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
                    F.array_sort(base).alias("base"), F.array_sort("linked").alias("linked"),
                    _listed(F.concat(base, F.col("linked"))).alias("spans")))
