"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

# fixed values: the kinds in their order, the pattern of each, its group that is the secret, and the least length of that
KINDS: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("live", r"[A-Za-z0-9+/_=-]{24,}", 0, 24),
)
#: What a document must hold for the slower search of a kind to be worth while; implied by the kind's pattern.
_HINTS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA[A-Z0-9]", "hex": "[0-9a-f]{16}", "live": "[A-Za-z0-9+/_=-]{24}"}
BASE_KINDS = 3
#: A secret that so many owners hold, or one owner in so many repositories, is a copied example.
COPIED_OWNERS, COPIED_REPOS = 3, 20


def _hits(text: Column, kind: int) -> Column:
    """Matches of a kind in their order: the characters since the last match, the match's length, the secret's hash."""
    name, pattern, group, least = KINDS[kind]

    def hit(gap: Column, match: Column) -> Column:
        secret = F.regexp_extract(match, pattern, group) if group else match
        ok = F.length(secret) >= least
        if name == "live":
            ok = ok & match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
        return F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(match).alias("width"), F.when(match.isNotNull() & ok, F.sha2(secret, 256)).alias("secret"), match.isNull().alias("rest"))

    found = F.filter(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), hit), lambda h: ~h["rest"])
    none = F.array().cast("array<struct<kind:int,gap:int,width:int,secret:string,rest:boolean>>")
    return F.when(text.rlike(_HINTS[name]), found).otherwise(none)


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """(row, id, repo, owner, kind, start, end, secret) of every match that holds; a row without any has one with a null kind."""
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hits = F.concat(*(_hits(F.col("text"), k) for k in range(len(KINDS))))
    rows = written(named.select("row", "id", "repo", "owner", hits.alias("hits")), "hits")
    each = rows.select("row", "id", "repo", "owner", F.posexplode_outer("hits").alias("pos", "hit")).select("row", "id", "repo", "owner", "pos", "hit.kind", "hit.gap", "hit.width", "hit.secret")
    passed = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(passed)).withColumn("start", F.col("end") - F.col("width"))
    holds = F.col("secret").isNotNull()
    return placed.select("row", "id", "repo", "owner", *(F.when(holds, F.col(c)).alias(c) for c in ("kind", "start", "end", "secret")))


def ownership(found: DataFrame) -> DataFrame:
    """(secret, owners, repos): distinct owners and repositories that hold a secret.

    Each is first made distinct with the secret, then counted with partial sums, so a secret that a third of
    all rows hold is no hot group. Null owners or repositories count as one.
    """
    own = found.where("secret IS NOT NULL").select("secret", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
    owners = own.select("secret", "owner").distinct().groupBy("secret").agg(F.count(F.lit(1)).alias("owners"))
    repos = own.select("secret", "repo").distinct().groupBy("secret").agg(F.count(F.lit(1)).alias("repos"))
    return owners.join(repos, "secret")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """(id, spans) for every row; spans are (start, kind, end, secret, owners, repos, copied), by start and kind.

    Matches of the base kinds stay whatever their ownership; of the kind live only those stay that fewer
    than copied_owners owners hold, in fewer than copied_repos repositories. copied tells the two apart for every span. Null and empty texts have no
    spans; repeated rows keep their rows; other columns are not looked at.
    """
    found = written(candidates(docs, id_col, text_col, repo_col, owner_col), "candidates")
    freq = written(ownership(found), "ownership")
    held = found.where("secret IS NOT NULL").join(freq, "secret", "left")
    none = found.where("secret IS NULL").withColumn("owners", F.lit(None).cast("bigint")).withColumn("repos", F.lit(None).cast("bigint"))
    copied = F.coalesce((F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos), F.lit(False))
    known = held.unionByName(none).withColumn("copied", copied)
    span = F.when((F.col("kind") < BASE_KINDS) | ((F.col("kind") >= BASE_KINDS) & ~F.col("copied")), F.struct("start", "kind", "end", "secret", "owners", "repos", "copied"))
    return known.groupBy("row", "id").agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def op5_secret_ownership(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < BASE_KINDS)
    count = lambda cond: F.size(F.filter("spans", cond)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    return found.select(
        F.col("id").alias("doc_id"), *(of_kind(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE_KINDS)),
        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        count(lambda s: s["copied"]).alias("n_copied"), count(lambda s: ~s["copied"]).alias("n_owned"),
    )
