"""Splits that keep related records together.

Records are tied by the roster author their author value means, and by the page their url means; ties chain. Pages are first
reduced to the authors they join, so that the graph whose components are found has authors as its only nodes, whatever the
number of records. Components of one size and label profile (the commonest label, its share in quarters, the next label) form a bundle;
a component above a 500th of all is a bundle by itself. A min-cost flow over bundles and splits, with costs for deviating from the
quotas by split and by profile within a split, gives shares that are rounded to whole components, the largest first; what the large
ones take is then given to the flow of the others. Members of a bundle are told apart by the rank of a hash.

To the driver come a bounded number of bundles: sizes above 256 are told apart by a sixteenth of a power of two, and profiles beyond the 256
commonest share one.

Nulls: a null or unknown author and a null or blank url tie nothing; a record without ties is a component by itself. Repeated
rows are records of their own, with the same ties. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zrno.operators.components import connected_components, ranked
from zrno.session import cut

#: Forms that stand for an unknown author, folded.
PLACEHOLDERS = ("", "?", "-", "—", "–", "n n", "nn", "n.n.", "neznan", "neznani avtor", "neznana avtorica", "anonimno", "anonim", "anonymous", "unknown", "brez avtorja", "ur", "ured", "uredništvo", "več avtorjev", "razni", "razni avtorji")
_YEARS = re.compile(r"[(\[]?\s*(?:\*|ok\.\s*)?(\d{3,4})?\s*[-–—/]\s*(?:†\s*)?(\d{3,4})?\s*[)\]]?\s*$")


def name_keys(form: str | None) -> list[str]:
    """Keys of a written name, strongest first: the set of its parts, or initial and surname where a part is an initial; then the same without letter marks."""
    if form is None:
        return []
    s = " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFKC", form)).casefold().split()).strip(" ,;.")
    if s in PLACEHOLDERS:
        return []
    m = _YEARS.search(s)
    if m and (m[1] or m[2]):
        s = s[: m.start()].strip(" ,;")
    parts = [p for p in re.split(r"[\s,;.]+", s) if p]
    if not parts or all(len(p) == 1 for p in parts):
        return []
    long = sorted(p for p in parts if len(p) > 1)
    short = sorted(p for p in parts if len(p) == 1)
    key = "i:" + "".join(short[:1]) + ":" + " ".join(long) if short else "f:" + " ".join(long)
    plain = "".join(c for c in unicodedata.normalize("NFD", key) if not unicodedata.combining(c)).replace("đ", "d")
    return [key, "m" + ":".join([*plain.split(":")[:-1], " ".join(sorted(plain.split(":")[-1].split(" ")))])]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _name_keys(form: pd.Series) -> pd.Series:
    return form.map(name_keys)


def page_of(url: str | None) -> str | None:
    """The page a url means, however it is written: scheme, www and mobile hosts, case of host and route, escapes, old versions, index.php routes, stream and details addresses, fragments and a closing slash make no difference."""
    if url is None or not url.strip():
        return None
    u = unicodedata.normalize("NFC", url.strip())
    u = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", u)
    u = u.split("#", 1)[0]
    head, _, query = u.partition("?")
    host, _, path = head.partition("/")
    host = host.lower().partition(":")[0]
    host = ".".join(p for p in host.split(".") if p not in ("www", "m"))
    title = re.search(r"(?:^|&)title=([^&]*)", query)
    route, _, rest = path.rstrip("/").partition("/")
    route = route.lower()
    if title:
        route, rest = "wiki", title[1]
    rest = unicodedata.normalize("NFC", unquote(rest)).strip("/ ").replace(" ", "_")
    urn = re.search(r"(urn:[a-z0-9:]+-[a-z0-9]+)", rest, re.I)
    if urn:
        return f"{host}/{urn[1].upper()}"
    return f"{host}/{route}/{rest}"


@F.pandas_udf(T.StringType())
def page_key(url: pd.Series) -> pd.Series:
    return url.map(page_of)


def author_ids(forms: DataFrame, roster: DataFrame) -> DataFrame:
    """(author, author_id) for every distinct form that leads to exactly one roster author through name or alias."""
    names = roster.where("author_id is not null").select("author_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    full = names.select("author_id", F.explode(_name_keys("name")).alias("key"))
    initial = names.select("author_id", F.explode(_name_keys(F.regexp_replace("name", r"^\s*(\p{L})[\p{L}\p{M}'’-]*", "$1."))).alias("key"))
    keys = full.union(initial).distinct().groupBy("key").agg(F.min("author_id").alias("author_id"), F.max("author_id").alias("_hi")).where("author_id = _hi").drop("_hi")
    return forms.select("author", F.posexplode(_name_keys("author")).alias("rank", "key")).join(keys, "key").groupBy("author").agg(F.min_by("author_id", "rank").alias("author_id"))


def entities(docs: DataFrame, roster: DataFrame) -> DataFrame:
    """(rec_id, source, page, author_id, group_id): group_id is the smallest author_id the record is tied to, null for none."""
    d = docs.select("rec_id", "source", "author", page_key("url").alias("page"))
    ids = author_ids(d.select("author").where("author is not null").distinct(), roster)
    d = cut(d.join(ids, "author", "left").drop("author"), "entities")
    joint = d.where("author_id is not null and page is not null").groupBy("page", "author_id").agg(F.lit(1).alias("_1")).drop("_1")
    low = joint.groupBy("page").agg(F.min("author_id").alias("low"))
    edges = joint.join(low, "page").select(F.col("author_id").alias("a"), F.col("low").alias("b")).distinct()
    alone = d.where("author_id is not null").select(F.col("author_id").alias("a"), F.col("author_id").alias("b")).distinct()
    of_author = cut(connected_components(edges.union(alone)), "authors")
    own = d.join(of_author.withColumnRenamed("node", "author_id").withColumnRenamed("component", "_own"), "author_id", "left")
    of_page = low.join(of_author, low.low == of_author.node).select("page", F.col("component").alias("_page"))
    with_author, without = own.where("_own is not null"), own.where("_own is null")
    return with_author.select("rec_id", "source", "page", "author_id", F.col("_own").alias("group_id")).union(
        without.join(of_page, "page", "left").select("rec_id", "source", "page", "author_id", F.col("_page").alias("group_id"))
    )


class Flow:
    """Min-cost flow by successive shortest paths with potentials, for small networks with whole capacities."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def arc(self, u: int, v: int, cap: int, cost: int) -> int:
        for a, b, c, w in ((u, v, cap, cost), (v, u, 0, -cost)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def solve(self, s: int, t: int) -> int:
        """The total cost of a largest flow of least cost; costs must not be negative."""
        n, total = len(self.out), 0
        pot = [0] * n
        while True:
            dist: list[float] = [float("inf")] * n
            via = [-1] * n
            dist[s] = 0
            heap = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for e in self.out[u]:
                    v = self.to[e]
                    if self.cap[e] > 0 and (nd := d + self.cost[e] + pot[u] - pot[v]) < dist[v]:
                        dist[v], via[v] = nd, e
                        heapq.heappush(heap, (nd, v))
            if dist[t] == float("inf"):
                return total
            pot = [p + d if d < float("inf") else p for p, d in zip(pot, dist)]
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            f = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= f
                self.cap[e ^ 1] += f
                total += f * self.cost[e]


def quotas(n: int, shares: list[float]) -> list[int]:
    """n in whole parts by shares, largest remainders first."""
    raw = [n * x for x in shares]
    q = [int(x) for x in raw]
    for k in sorted(range(len(raw)), key=lambda k: q[k] - raw[k])[: n - sum(q)]:
        q[k] += 1
    return q


def flows(masses: list[tuple[str, int, list[int]]], want: list[int], of_profile: dict[str, list[int]], split_cost: int, profile_cost: int) -> list[list[int]]:
    """Records of each bundle (profile, records, splits it may go to) for each split, at the least cost: split_cost for a record beyond a split's quota, profile_cost for one beyond a profile's quota within a split."""
    j, b, names = len(want), len(masses), sorted(of_profile)
    node = {(x, k): 2 + b + i * j + k for i, x in enumerate(names) for k in range(j)}
    end = 2 + b + len(names) * j
    flow, total = Flow(end + j), sum(n for _, n, _ in masses)
    arcs = {}
    for i, (profile, n, may) in enumerate(masses):
        flow.arc(0, 2 + i, n, 0)
        for k in may:
            arcs[i, k] = flow.arc(2 + i, node[profile, k], n, 0)
    for x in names:
        for k, q in enumerate(of_profile[x]):
            flow.arc(node[x, k], end + k, q, 0)
            flow.arc(node[x, k], end + k, total, profile_cost)
    for k, q in enumerate(want):
        flow.arc(end + k, 1, q, 0)
        flow.arc(end + k, 1, total, split_cost)
    flow.solve(0, 1)
    return [[flow.cap[arcs[i, k] ^ 1] if (i, k) in arcs else 0 for k in range(j)] for i in range(b)]


def allocate(bundles: list[tuple[float, str, int]], shares: dict[str, float], heavy: list[tuple[int, str]] = [], split_cost: int = 20, profile_cost: int = 3) -> tuple[dict[tuple[float, str], list[int]], list[int]]:  # noqa: B006
    """({(size, profile): components for each split}, [split of each heavy component]) for bundles (mean size, profile, count) and heavy components (size, profile).

    All are in one flow; a heavy component may go to splits whose quota holds it, else to the largest. Heavy ones are rounded
    first, to the split that most of their records flow to; a second flow shares out the others over what is left. Bundles of one profile
    are alike to the flow, so it has one node for each profile; their components are then dealt whole, the largest first.
    """
    part = list(shares.values())
    j = len(part)
    light: dict[str, float] = {}
    for size, profile, n in bundles:
        light[profile] = light.get(profile, 0) + size * n
    mass = {x: round(m) for x, m in light.items()}
    every = dict(mass)
    for size, profile in heavy:
        every[profile] = every.get(profile, 0) + size
    want = quotas(sum(every.values()), part)
    of_profile = {x: quotas(m, part) for x, m in every.items()}
    big = max(range(j), key=lambda k: want[k])
    order = sorted(range(len(heavy)), key=lambda i: (-heavy[i][0], heavy[i][1], i))
    where = [big] * len(heavy)
    if heavy:
        may = [[k for k in range(j) if heavy[i][0] <= want[k]] or [big] for i in order]
        names = sorted(mass)
        got = flows([(heavy[i][1], heavy[i][0], m) for i, m in zip(order, may)] + [(x, mass[x], list(range(j))) for x in names], want, of_profile, split_cost, profile_cost)
        room = list(want)
        for i, m, f in zip(order, may, got):
            size, profile = heavy[i]
            fits = [k for k in m if room[k] >= size] or m
            where[i] = k = max(fits, key=lambda k: (f[k], room[k], -k))
            room[k] -= size
            of_profile[profile][k] -= size
        want = room
    rest = [max(0, x) for x in want]
    of_light = {x: [max(0, q) for q in of_profile[x]] for x in mass}
    names = sorted(mass)
    share = dict(zip(names, flows([(x, mass[x], list(range(j))) for x in names], rest, of_light, split_cost, profile_cost)))
    out: dict[tuple[float, str], list[int]] = {}
    missing = {x: [float(q) for q in f] for x, f in share.items()}
    lacking = [float(sum(f[k] for f in share.values())) for k in range(j)]
    for size, profile, n in sorted(bundles, key=lambda r: (-r[0], r[1])):
        lack = missing[profile]
        have = sum(max(0.0, x) for x in lack)
        x = [int(n * max(0.0, y) / have) if have else 0 for y in lack]
        for k in range(j):
            lack[k] -= x[k] * size
            lacking[k] -= x[k] * size
        for _ in range(n - sum(x)):  # fewer than the number of splits, unless nothing is missing
            k = min(range(j), key=lambda k: (split_cost * (abs(lacking[k] - size) - abs(lacking[k])) + profile_cost * (abs(lack[k] - size) - abs(lack[k])), k))
            x[k] += 1
            lack[k] -= size
            lacking[k] -= size
        out[size, profile] = x
    return out, where


def assign_splits(tied: DataFrame, shares: dict[str, float], seed: int = 1, heavy: int = 500, profiles: int = 256) -> DataFrame:
    """(rec_id, component, split) from the result of entities().

    heavy: components above so small a part of all, so many at most, are bundles by themselves; profiles: so many are told apart.
    """
    d = tied.withColumn("component", F.coalesce(F.concat(F.lit("a:"), "group_id"), F.concat(F.lit("p:"), "page"), F.concat(F.lit("r:"), "rec_id"), F.lit("r:")))
    d = cut(d.select("rec_id", "component", F.coalesce("source", F.lit("")).alias("label")), "parts")
    by = d.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("n", "label")), False), 1, 2)  # as many labels as there are sources
    comps = by.groupBy("component").agg(F.sum("n").alias("size"), top.alias("top"))
    one, two = F.try_element_at("top", F.lit(1)), F.try_element_at("top", F.lit(2))
    profile = F.concat_ws("|", one["label"], F.round(4 * one["n"] / F.col("size")).cast("int"), F.coalesce(two["label"], F.lit("")))
    comps = cut(comps.select("component", "size", profile.alias("profile")), "components")
    total = comps.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = [(r.component, r["size"], r.profile) for r in comps.where(F.col("size") * heavy > total).orderBy("component").collect()]
    small = comps.where(F.col("size") * heavy <= total)
    common = [r.profile for r in small.groupBy("profile").agg(F.sum("size").alias("m")).orderBy(F.desc("m"), "profile").limit(profiles).collect()]
    spark, names = tied.sparkSession, list(shares)
    told = spark.createDataFrame([(x, x) for x in common], "profile string, known string")
    grade = F.when(F.col("size") <= 256, F.col("size").cast("long")).otherwise(F.floor(F.log2("size") * 16).cast("long") + 256)
    small = small.join(F.broadcast(told), "profile", "left").select("component", "size", grade.alias("grade"), F.coalesce("known", F.lit("*")).alias("profile"))
    rows = small.groupBy("grade", "profile").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).orderBy("grade", "profile").collect()
    plan, where = allocate([(r["mean"], r.profile, r.n) for r in rows], shares, [(n, x if x in common else "*") for _, n, x in large])
    deal = [(r.grade, r.profile, k, sum(x[:k]), sum(x[: k + 1])) for r in rows for x in [plan[r["mean"], r.profile]] for k in range(len(names)) if x[k]]
    plan_df = spark.createDataFrame(deal, "grade long, profile string, k int, lo long, hi long")
    name = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("k") + 1)
    dealt = ranked(small, ["grade", "profile"], F.xxhash64("component", F.lit(seed))).join(F.broadcast(plan_df), ["grade", "profile"]).where("rn > lo and rn <= hi").select("component", name.alias("split"))
    whole = spark.createDataFrame([(c, names[k]) for (c, _, _), k in zip(large, where)], "component string, split string")
    return d.join(dealt.union(whole), "component").select("rec_id", "component", "split")
