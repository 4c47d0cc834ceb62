"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Every whole text is searched once for candidates. How many owners and repositories hold a candidate's hash tells
widely copied examples (of documentation, tutorials, defaults) from credentials that only one owner has.

Spark has no function that gives the places of all matches. Splitting a text by the same pattern gives the pieces
between the matches, and running sums over the lengths of pieces and matches give the places, in code points. The sums
come by doubling, so a text may hold any number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.spans import between, let, places, running_max
from parchmint.llm.common import cut, free, fresh, small_side

#: Fixed patterns, by kind.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # of [0-9a-f]+ the runs that are long enough; shorter ones hide none
#: What the method adds where only one owner has it: a long unbroken string with digits and letters of both cases.
OPAQUE = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
#: Owners from which on a candidate is a copied example.
OWNERS = 3
#: Repositories from which on it is one too, however few owners they have.
REPOS = 10


SPANS = "array<struct<start:bigint,kind_order:int,end:bigint,value:string>>"


def _search(rows: DataFrame, kind: int, pattern: str) -> DataFrame:
    """rows with an array of (start, kind_order, end, value) of all matches of a kind."""
    both = F.struct(F.regexp_extract_all("body", F.lit(pattern), F.lit(0)).alias("m"), F.split("body", pattern, -1).alias("p"))
    one = lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind_order"), e.alias("end"), m.alias("value"))
    found = F.when(F.col("body").rlike(pattern), let(both, lambda x: F.zip_with(places(x["p"], x["m"]), x["m"], one)))
    return rows.withColumn(KINDS[kind], F.coalesce(found, F.array().cast(SPANS)))


def _spans(rows: DataFrame, kept: list[str]) -> DataFrame:
    """rows (with the text as body) with base and opaque spans instead of the body; each has the hash of its credential."""
    for kind, pattern in enumerate((ASSIGN, ACCESS, HEX, OPAQUE)):
        rows = _search(rows, kind, pattern)
    value = F.regexp_extract
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.length(value(s["value"], ASSIGN, 2)) >= 8))
    rows = rows.withColumn("access", F.filter("access", lambda s: F.length(s["value"]) >= 16))
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    rows = rows.withColumn("opaque", F.filter("opaque", lambda s: mixed(s) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))

    def hashed(s):
        secret = F.when(s["kind_order"] == 0, value(s["value"], ASSIGN, 2)).otherwise(s["value"])
        return F.struct(s["start"], s["kind_order"], s["end"], (s["end"] - F.length(secret)).alias("value_start"), F.sha2(secret, 256).alias("hash"))

    return rows.select(*kept, F.transform("base", hashed).alias("base"), F.transform("opaque", hashed).alias("opaque"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, owner, repo, and base and opaque spans; no text."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{owner_col}`").cast("string").alias("owner"), F.col(f"`{repo_col}`").cast("string").alias("repo"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    return _spans(rows, ["doc_id", "owner", "repo"])


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind_order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(found: DataFrame) -> DataFrame:
    """Owners and repositories of each candidate hash that more than one row holds. Null owners count as one."""
    each = found.select("owner", "repo", F.explode(F.concat("base", "opaque")).alias("s")).select(F.col("s.hash").alias("hash"), "owner", "repo")
    repos = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("n_repos"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners")).where("n > 1")


def copied(n_owners: Column, n_repos: Column, owners: int, repos: int) -> Column:
    """Whether a candidate of so many owners and repositories is a copied example."""
    return (n_owners >= owners) | (n_repos >= repos)


MASK = "[SECRET]"


def redact(docs: DataFrame, owners: int = OWNERS, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mask: str = MASK, repos: int = REPOS) -> DataFrame:
    """The rows of docs, with all their columns; in the text, credentials that fewer than `owners` owners and fewer than
    `repos` repositories have are masked.

    Only the credential goes: of an assignment the value, not the name. Credentials of copied examples stay. What is
    masked by one mask may be several candidates that overlap. A null text stays null; rows that repeat stay.
    """
    text = F.col(f"`{text_col}`").cast("string")
    k1, k2, masks_col = fresh(docs.columns, "k1", "k2", "masks")
    row_key = [F.xxhash64(F.lit(seed), F.col(f"`{repo_col}`").cast("string"), text) for seed in (1, 2)]
    rows = docs.select(F.col(f"`{owner_col}`").cast("string").alias("owner"), F.col(f"`{repo_col}`").cast("string").alias("repo"), F.coalesce(text, F.lit("")).alias("body"), *[c.alias(name) for c, name in zip(row_key, ("k1", "k2"))])
    found = cut(_spans(rows, ["owner", "repo", "k1", "k2"]).where(F.size("base") + F.size("opaque") > 0))
    often = cut(ownership(found))
    each = found.select("k1", "k2", F.explode(F.concat("base", "opaque")).alias("s")).select("k1", "k2", "s.*").distinct()
    each = each.join(often, "hash", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("n_owners", "n_repos")})
    live = each.where(~copied(F.col("n_owners"), F.col("n_repos"), owners, repos) & ((F.col("kind_order") < 3) | (F.col("n_owners") < 2)))
    masks = cut(live.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("value_start", "end"))).alias("masks")))
    free(found, often)
    whole, held = F.col(f"`{text_col}`"), F.col(f"`{masks_col}`")

    def merged(x):
        """Masks that overlap are one: each goes from a start that no mask before reaches to the furthest end before the next."""
        starts = F.filter(F.transform(x["m"], lambda m, i: F.when((i == 0) | (m["value_start"] >= F.get(x["far"], i - 1)), i)), lambda i: i.isNotNull())
        last = F.concat(F.transform(F.slice(starts, 2, F.size(starts)), lambda i: i - 1), F.array(F.size(x["m"]) - 1))
        return F.zip_with(starts, last, lambda i, j: F.struct(F.get(x["m"], i)["value_start"].alias("start"), F.get(x["far"], j).alias("end")))

    far = F.struct(held.alias("m"), running_max(F.transform(held, lambda m: m["end"])).alias("far"))
    masked = F.when(held.isNotNull(), F.array_join(let(let(far, merged), lambda spans: between(whole, spans)), mask)).otherwise(whole)
    joined = docs.withColumns({k1: row_key[0], k2: row_key[1]}).join(small_side(masks).toDF(k1, k2, masks_col), [k1, k2], "left")
    return joined.select(*[masked.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def scan(docs: DataFrame, owners: int = OWNERS, repos: int = REPOS, evidence: bool = False, **columns) -> DataFrame:
    """Per row: base counts and digest, all spans, and how many candidates are live-looking or copied.

    With evidence, also held: kind, start, end, n_owners and n_repos of each span.

    A null or empty text has no spans. Rows that repeat are repeated, and count as one repository. A null owner or
    repository counts like any other. Overlapping spans of different kinds all stay.
    """
    found = cut(candidates(docs, **columns)).withColumn("row", F.monotonically_increasing_id())

    def number(k):
        return F.size(F.filter("base", lambda s: s["kind_order"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [number(k) for k in range(3)]
    plain = found.select("row", "doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), F.concat("base", "opaque").alias("all"))
    # the frequencies are cut off from their plan so that the join sees two plain shuffles and can split a hot hash
    frequent = cut(ownership(found))
    kind = "array<struct<start:bigint,kind_order:int,end:bigint,n_owners:bigint,n_repos:bigint>>"
    without = plain.where(F.size("all") == 0).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array().cast(kind).alias("seen"))
    each = plain.where(F.size("all") > 0).select("row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.explode("all").alias("s")).withColumn("hash", F.col("s.hash"))
    joined = each.join(frequent, "hash", "left")
    one = F.struct(F.col("s.start").alias("start"), F.col("s.kind_order").alias("kind_order"), F.col("s.end").alias("end"), *[F.coalesce(c, F.lit(1).cast("long")).alias(c) for c in ("n_owners", "n_repos")])
    grouped = joined.groupBy("row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256").agg(F.array_sort(F.collect_list(one)).alias("seen"))
    rows = without.unionByName(grouped.drop("row"))
    rows = rows.withColumn("kept", F.filter("seen", lambda s: (s["kind_order"] < 3) | (s["n_owners"] < 2)))
    live = F.filter("kept", lambda s: ~copied(s["n_owners"], s["n_repos"], owners, repos))
    name = F.array(*map(F.lit, KINDS))
    held = F.transform("kept", lambda s: F.struct(F.element_at(name, s["kind_order"] + 1).alias("kind"), s["start"], s["end"], s["n_owners"], s["n_repos"])).alias("held")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", told(F.col("kept")).alias("spans"), F.size(live).cast("long").alias("n_live"), (F.size("kept") - F.size(live)).cast("long").alias("n_copied"), *([held] if evidence else []))
