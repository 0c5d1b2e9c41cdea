"""Secret scans with corpus-wide ownership frequency.

Base kinds are found by their patterns, leftmost and non-overlapping, with code-point spans: a text
is split at a pattern's matches, and running sums over the parts' and matches' lengths give
the places. Other runs that look like credentials (``LOOSE_CHARS`` or more of a token's characters, with
letters and digits) are candidates. Every candidate's hash is counted over the corpus by distinct
repositories and distinct owners: a value held by more than ``MOST_OWNERS`` owners or
``MOST_REPOSITORIES`` repositories is a widely copied example, the rest is owner-specific and looks live. The method adds
the live-looking loose candidates as spans of kind ``owned``; base spans stay either way and are
counted as live or example.

Only DataFrame functions run. Texts that can hold no candidate leave after cheap tests; the others' spans
are exploded and summed by text. Distinct (value, owner, repository) rows are combined before
they are shuffled, so a value in a third of all texts is a few rows a task.

Without a repository column an owner's documents are one repository.

Defined results: a null text is empty and has no spans; a null owner or repository is one of its own; spans that begin together
are listed by kind; repeated rows each come back; very long texts are whole; no column but the named ones is read; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm import common as C

# The base kinds' patterns, the group that holds the value, its least length.
ASSIGN = (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
LOOSE_CHARS = 20
LOOSE = r"[A-Za-z0-9+/_-]{%d,}" % LOOSE_CHARS
MOST_OWNERS = 2
MOST_REPOSITORIES = 4
MASK = "[SECRET]"
RANK = {"assign": 0, "access": 1, "hex": 2, "owned": 3}
# A pattern of one kind that finds the same matches and less work: short runs of hex digits fail either way.
_SCAN = {"hex": r"[0-9a-f]{24,}"}


def _tagged(docs: DataFrame, doc_id: str, text: str, owner: str, repository: str | None) -> DataFrame:
    """(row, doc_id, owner, repository, text) with the text only where it may hold a candidate."""
    low = F.lower(F.col("t"))
    words = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    loose = F.col("t").rlike("[0-9]") & F.col("t").rlike("[A-Za-z0-9+/_-]{%d}" % LOOSE_CHARS)
    may = words | F.col("t").contains("AKIA") | loose | F.col("t").rlike("[0-9a-f]{24}")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).cast("string").alias("owner"), (F.col(repository) if repository else F.col(owner)).cast("string").alias("repository"), F.col(text).alias("t"))
    return C.written(rows.select("doc_id", "owner", "repository", F.when(may, F.col("t")).alias("text")).withColumn("row", F.monotonically_increasing_id()), "secrets")


def _matches(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, value) of every candidate, of rows (row, text)."""
    def found(pattern, group):
        cut = F.lit(pattern)
        return F.arrays_zip(F.split("text", pattern, -1).alias("part"), F.regexp_extract_all("text", cut, 0).alias("whole"), F.regexp_extract_all("text", cut, group).alias("value"))

    kinds = [F.struct(F.lit(kind).alias("kind"), found(_SCAN.get(kind, pattern), group).alias("cuts")) for kind, pattern, group, _ in KINDS]
    kinds.append(F.struct(F.lit("owned").alias("kind"), found(LOOSE, 0).alias("cuts")))
    each = rows.select("row", F.explode(F.array(*kinds)).alias("k")).where("size(k.cuts) > 1").select("row", "k.kind", F.posexplode("k.cuts").alias("at", "cut"))
    each = each.select("row", "kind", "at", F.length("cut.part").alias("gap"), F.length("cut.whole").alias("long"), F.col("cut.value").alias("value"))
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.coalesce("long", F.lit(0))).over(before)
    placed = each.withColumn("end", end).where("long is not null").withColumn("start", F.col("end") - F.col("long"))
    fits = F.lit(False)
    for kind, _, _, least in KINDS:
        fits = fits | ((F.col("kind") == kind) & (F.length("value") >= least))
    fits = fits | ((F.col("kind") == "owned") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    return placed.where(fits).select("row", "kind", "start", "end", F.xxhash64("value").alias("value"))


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (row, doc_id, text) of all documents, text null where nothing was found;
    spans (row, kind, start, end, live) of base and owned spans."""
    rows = _tagged(docs, doc_id, text, owner, repository)
    found = C.written(_matches(rows.where("text is not null").select("row", "text")), "candidates")
    held = found.join(rows.select("row", "owner", "repository"), "row").select("value", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository")).distinct()
    counts = held.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("owner", "repository").alias("repositories"))
    live = (F.col("owners") <= MOST_OWNERS) & (F.col("repositories") <= MOST_REPOSITORIES)
    judged = C.written(found.join(counts.select("value", live.alias("live")), "value"), "judged")
    base = judged.where("kind <> 'owned'")
    # A loose candidate that shares a character with a base span is that span's.
    both = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(1, Window.unboundedFollowing)
    is_base = F.col("kind") != "owned"
    marked = judged.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(both)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(after))
    own = marked.where("kind = 'owned' and live and coalesce(reach <= start, true) and coalesce(next >= end, true)")
    return rows, base.select("row", "kind", "start", "end", "live").unionByName(own.select("row", "kind", "start", "end", "live"))


def _listed(spans, base: bool):
    chosen = F.filter(spans, lambda s: s["rank"] < 3) if base else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _gathered(docs: DataFrame, **names) -> tuple[DataFrame, DataFrame]:
    rows, spans = secret_spans(docs, **names)
    rank = F.lit(None).cast("int")
    for kind, n in RANK.items():
        rank = F.when(F.col("kind") == kind, n).otherwise(rank)
    one = F.struct("start", rank.alias("rank"), "end", "kind", "live")
    return rows, spans.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("found"))


def scan(docs: DataFrame, **names) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live."""
    rows, found = _gathered(docs, **names)
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,live:boolean>>")
    all_ = rows.select("row", "doc_id").join(found, "row", "left").withColumn("found", F.coalesce("found", none))

    def count(test):
        return F.size(F.filter("found", test)).cast("long")

    def of(kind):
        return count(lambda s: s["kind"] == kind)

    return all_.select("doc_id", *(of(k).alias("n_" + k) for k in ("assign", "access", "hex")), F.sha2(_listed(F.col("found"), True), 256).alias("base_sha256"),
                       _listed(F.col("found"), False).alias("spans"), of("owned").alias("n_owned"), count(lambda s: s["live"]).alias("n_live"))


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by MASK; other texts and all other columns, whatever their
    names, as they are."""
    columns = docs.columns
    inside = {c: f"c{i}" for i, c in enumerate(columns)}
    docs = C.written(docs.toDF(*inside.values()).withColumn("_key", F.monotonically_increasing_id()), "texts")
    rows, found = _gathered(docs, doc_id="_key", text=inside[text], owner=inside[owner], repository=repository and inside[repository])
    text = inside[text]
    hits = rows.join(found, "row").select(F.col("doc_id").alias("_hit"), "found")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(t):
        def add(a, s):
            fresh = F.concat(a["out"], t.substr(a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit(MASK))
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))
        return add

    t = F.col(text)
    new = F.aggregate("found", start, step(t), lambda a: F.concat(a["out"], t.substr(a["at"].cast("int") + 1, F.length(t))))
    joined = docs.join(hits, F.col("_key") == F.col("_hit"), "left")
    return joined.withColumn(text, F.when(F.col("found").isNotNull(), new).otherwise(t)).select(*inside.values()).toDF(*columns)


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') text, coalesce(source, chr(0)) owner from documents),
k(kind, rank, pat, grp, least) as (values ('assign', 0, '%ASSIGN%', 2, 6), ('access', 1, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 2, '[0-9a-f]{24,}', 0, 24), ('owned', 3, '[A-Za-z0-9+/_-]{20,}', 0, 20)),
raw as (
  select doc_id, owner, 'assign' kind, 0 rank, 6 least, string_split_regex(text, '%ASSIGN%') part, regexp_extract_all(text, '%ASSIGN%', 0) whole, regexp_extract_all(text, '%ASSIGN%', 2) val from t
  union all select doc_id, owner, 'access', 1, 20, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') from t
  union all select doc_id, owner, 'hex', 2, 24, string_split_regex(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}') from t
  union all select doc_id, owner, 'owned', 3, 20, string_split_regex(text, '[A-Za-z0-9+/_-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}') from t),
m as (select doc_id, owner, kind, rank, least, val[i] v, length(whole[i]) n, list_sum(list_transform(part[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) s
      from raw, unnest(range(1, len(whole) + 1)) u(i)),
f as (select doc_id, owner, kind, rank, v, s::bigint s, (s + n)::bigint e from m where length(v) >= least and (kind <> 'owned' or (regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')))),
c as (select v, count(distinct owner) <= 2 live from f group by v),
j as (select f.*, live from f join c on c.v = f.v),
o as (select * from j where kind <> 'owned' or (live and not exists (select 1 from j b where b.doc_id = j.doc_id and b.kind <> 'owned' and b.s < j.e and j.s < b.e))),
g as (select doc_id, count(*) filter (kind = 'assign') a, count(*) filter (kind = 'access') x, count(*) filter (kind = 'hex') h, count(*) filter (kind = 'owned') w, count(*) filter (live) l,
      coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (kind <> 'owned'), '') base, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) spans from o group by doc_id)
select t.doc_id, coalesce(a, 0)::bigint n_assign, coalesce(x, 0)::bigint n_access, coalesce(h, 0)::bigint n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans,
  coalesce(w, 0)::bigint n_owned, coalesce(l, 0)::bigint n_live from t left join g on g.doc_id = t.doc_id
""".replace("%ASSIGN%", ASSIGN.replace("'", "''"))
