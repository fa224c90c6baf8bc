"""Secret scan with multipart credential linking, in DataFrame functions alone.

Plain secrets (assignments, access identifiers, long hex runs) are spans of regular expressions. `split` gives the gaps
between matches and `regexp_extract_all` the matches, so that running sums of their lengths, in blocks, are exact code
point offsets. Weak parts (short access identifiers, bare high-variety strings, endpoints) say nothing alone: they are
reported only if a complementary part lies within `scope` characters: an identifier needs a secret of any kind, a bare
secret an identifier, and an endpoint an identifier or a secret that isn't merely a hex run. That interval join runs on
(row, bucket of scope characters): the complementary parts are first reduced to the least and the greatest offset of each
bucket, and a weak part meets the buckets before, at and after its own. Overlaps are found on the same buckets, so no
text's parts are ever paired with all others. Each identifier is then tied to the nearest secret and endpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import load, materialize

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
WEAK_ID = r"\b(?:AKIA|ASIA|AIDA|AROA|key[-_]|id[-_]|client[-_])[A-Za-z0-9]{4,}"
WEAK_SECRET = r"[A-Za-z0-9+/_]{20,}={0,2}"
ENDPOINT = r"(?:https?|ftp|postgres|mysql|amqp|redis)://[A-Za-z0-9.:@/_%-]{3,}"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
SCOPE = 400


BLOCK = 256  # matches whose offsets are summed in one go


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, pattern: str) -> Column:
    """Array of (s, e) of the leftmost non-overlapping matches, in code points."""
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, pair: Column) -> Column:
        s = acc["at"] + pair["g"]
        e = s + pair["m"]
        return F.struct(F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"), e.alias("at"))

    def folded(pairs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        part = lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK)
        sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda acc, p: acc + p["g"] + p["m"]))
        starts = lambda s: F.transform(blocks, lambda b: F.aggregate(F.slice(s, F.lit(1), b), F.lit(0), lambda acc, x: acc + x))
        spans = lambda at: F.flatten(F.transform(blocks, lambda b: F.aggregate(part(b), F.struct(none.alias("out"), F.get(at, b).alias("at")), step, lambda acc: acc["out"])))
        return F.when(F.size(pairs) > 0, _let(sums, lambda s: _let(starts(s), spans))).otherwise(none)

    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    return _let(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m")), folded)


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].cast("long").alias("s"), F.lit(kind).alias("k"), x["e"].cast("long").alias("e")))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _none() -> Column:
    return F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """The spans of the three plain kinds as arrays of (s, k, e)."""
    said = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    long_enough = F.transform(said, lambda v: F.length(v) >= 8)
    assign = F.filter(F.transform(_spans(text, ASSIGN), lambda x, i: F.when(F.get(long_enough, i), x)), lambda x: x.isNotNull())
    access = F.filter(_spans(text, ACCESS), lambda x: x["e"] - x["s"] >= 16)
    return _kind(assign, 0), _kind(access, 1), _kind(_spans(text, HEX), 2)


def _near(parts: DataFrame, scope: int) -> DataFrame:
    """parts once for each of the buckets before, at and after its own, as `near`."""
    return parts.withColumn("near", F.explode(F.array(*(F.floor(F.col("s") / scope) + d for d in (-1, 0, 1)))))


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rid, s, k, e): the weak parts of (rid, s, k, e) that have a complementary part within scope characters.

    An access identifier (strong or weak) needs a secret or a hex run, a bare secret needs an identifier, and an endpoint
    needs an identifier or a secret. Distance is measured between starts.
    """
    role = F.when(F.col("k").isin(1, 3), "id").when(F.col("k").isin(0, 4), "secret").when(F.col("k") == 2, "digest").otherwise("endpoint")
    parts = parts.withColumn("role", role).withColumn("bucket", F.floor(F.col("s") / scope))
    ends = parts.filter("role <> 'endpoint'").groupBy("rid", "bucket", "role").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    said = lambda *roles: F.array(*map(F.lit, roles))
    wants = F.when(F.col("role") == "id", said("secret", "digest")).when(F.col("role") == "secret", said("id")).otherwise(said("id", "secret"))
    weak = _near(parts.filter(F.col("k") >= 3).withColumn("wants", F.explode(wants)), scope)
    met = weak.alias("w").join(
        ends.alias("c"),
        (F.col("w.rid") == F.col("c.rid")) & (F.col("near") == F.col("c.bucket")) & (F.col("wants") == F.col("c.role"))
        & F.when(F.col("near") < F.col("w.bucket"), F.col("w.s") - F.col("c.hi") <= scope).when(F.col("near") > F.col("w.bucket"), F.col("c.lo") - F.col("w.s") <= scope).otherwise(F.lit(True)),
    )
    return met.select("w.rid", "w.s", "w.k", "w.e").distinct()


def without_overlaps(parts: DataFrame, over: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The rows of parts (rid, s, k, e) that no row of over shares a character with: they meet on buckets of scope characters."""
    spread = lambda df: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / scope), F.floor((F.col("e") - 1) / scope))))
    p, o = spread(parts).alias("p"), spread(over).alias("o")
    met = p.join(o, (F.col("p.rid") == F.col("o.rid")) & (F.col("p.bucket") == F.col("o.bucket")) & (F.col("p.s") < F.col("o.e")) & (F.col("o.s") < F.col("p.e")), "left_semi")
    return parts.join(met.select("rid", "s", "k", "e").distinct(), ["rid", "s", "k", "e"], "left_anti")


def tied(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rid, s, k, e, secret, endpoint): each identifier with the nearest secret within scope, as (s, k, e), and the nearest endpoint, if any.

    Of two at the same distance the earlier one is taken; a hex run counts as a secret.
    """
    ids = _near(parts.filter(F.col("k").isin(1, 3)), scope).alias("i")
    rest = parts.filter(~F.col("k").isin(1, 3)).withColumn("bucket", F.floor(F.col("s") / scope)).alias("c")
    far = F.abs(F.col("i.s") - F.col("c.s"))
    met = ids.join(rest, (F.col("i.rid") == F.col("c.rid")) & (F.col("near") == F.col("c.bucket")) & (far <= scope))
    part, order = F.struct("c.s", "c.k", "c.e"), F.struct(far.alias("far"), "c.s", "c.k")
    best = lambda kind: F.min_by(F.when(kind, part), F.when(kind, order))
    return met.groupBy("i.rid", "i.s", "i.k", "i.e").agg(best(F.col("c.k") != 5).alias("secret"), best(F.col("c.k") == 5).alias("endpoint")).filter("secret is not null")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs: n_assign, n_access, n_hex, base_sha256, spans, n_linked, links, parts (array of kind, s, e).

    links has each identifier with its secret and, if there is one, its endpoint: kind:start:end joined by a plus sign.

    A null text is empty; repeated rows and null ids are kept; an empty table gives an empty result; extra columns are
    ignored. Weak parts that overlap a plain span are dropped. Base spans never depend on the linking.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    suspect = F.col("text").rlike(r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}")
    assign, access, hexes = base_spans(F.col("text"))
    weak_any = F.col("text").rlike(rf"{WEAK_ID}|{ENDPOINT}|AKIA")
    weak_id, weak_secret, endpoint = (_kind(_spans(F.col("text"), p), k) for k, p in ((3, WEAK_ID), (4, WEAK_SECRET), (5, ENDPOINT)))
    varied = F.filter(weak_secret, lambda x: F.substring(F.col("text"), x["s"].cast("int") + 1, (x["e"] - x["s"]).cast("int")).rlike(r"(?=.*[0-9])(?=.*[A-Za-z])"))
    rows = rows.withColumn("suspect", suspect).withColumn("weak_any", weak_any)
    rows = rows.select(
        "doc_id",
        F.when(F.col("suspect"), F.array_sort(F.concat(assign, access, hexes))).otherwise(_none()).alias("base"),
        F.when(F.col("weak_any"), F.concat(weak_id, endpoint, varied)).otherwise(_none()).alias("weak"),
    ).withColumn("rid", F.monotonically_increasing_id())
    rows = materialize(rows, "secrets")
    each = lambda column: rows.filter(F.size("weak") > 0).select("rid", F.explode(column).alias("p")).select("rid", "p.*")
    base = each("base")
    weak = materialize(without_overlaps(each("weak"), base, scope), "weak")
    clear = weak.filter("k <> 4").unionByName(without_overlaps(weak.filter("k = 4"), weak.filter("k <> 4"), scope))
    parts = materialize(base.unionByName(clear), "parts")
    linked = linked_parts(parts, scope)
    known = parts.filter("k = 1").unionByName(linked.filter("k = 3")).unionByName(parts.filter("k in (0, 2)")).unionByName(linked.filter("k > 3"))
    said = lambda c: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), F.col(c)["k"]), F.col(c)["s"].cast("string"), F.col(c)["e"].cast("string"))
    ties = tied(known, scope).withColumn("id", F.struct("s", "k", "e"))
    ties = ties.select("rid", "s", F.concat_ws("+", said("id"), said("secret"), F.when(F.col("endpoint").isNotNull(), said("endpoint"))).alias("link"))
    ties = ties.groupBy("rid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "link"))), lambda x: x["link"]), ",").alias("links"))
    linked = linked.groupBy("rid").agg(F.collect_list(F.struct("s", "k", "e")).alias("linked"))
    rows = rows.join(linked, "rid", "left").join(ties, "rid", "left").withColumn("linked", F.coalesce("linked", _none()))
    rows = rows.withColumn("parts", F.array_sort(F.concat("base", "linked")))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("parts")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"), F.coalesce("links", F.lit("")).alias("links"), "parts",
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents")).drop("parts")
