"""The works ledger: mutation by joins, coverage, collisions, validation, and matching of library records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zrno.functions.text import casefold, nfc, normal_title, slug, strip, without_author

SOURCE = "struct<source:string,id:string,status:string,year:int,note:string>"
# Patterns of attributions within titles, memorial titles and separators of title parts.
ATTRIBUTION, MEMORIAL, SEPARATOR, RIGHTS_FREE = r"(?i)(napisal|spisal|zložil)", r"(?i)^spominu\b|\bv spomin\b", r"\s*[:;|]\s*", "/pd/"
ENTRY, SECTION, SEE, YEAR = r"^\*+\s*'*\[\[([^\]|]+)(?:\|[^\]]*)?\]\]'*(.*)$", r"^==+\s*([^=]+?)\s*==+\s*$", r"gl\.\s*\[\[([^\]|]+)", r"(1[5-9]\d\d|20\d\d)"


def title_key(title: Column, author: Column) -> Column:
    return normal_title(without_author(nfc(title), author))


def upsert(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """The ledger (work_id, author, title, year, genre, flags) after entries (author, title, year, genre, flags) by author and title key.

    Null years and genres are filled by the first entry that has one, flags are united, unknown titles become works whose id is
    their slug. Entries are folded before they meet the ledger.
    """
    e = entries.withColumn("_k", title_key(F.col("title"), F.col("author"))).where("_k <> ''")
    e = e.groupBy("author", "_k").agg(F.min("title").alias("t"), F.min("year").alias("y"), F.min("genre").alias("g"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("flags", F.array().cast("array<string>")))))).alias("f"))
    d = ledger.withColumn("_k", title_key(F.col("title"), F.col("author")))
    j = d.join(e, ["author", "_k"], "full")
    none = F.array().cast("array<string>")
    return j.select(F.coalesce("work_id", slug(F.coalesce("_k", F.lit("")))).alias("work_id"), "author", F.coalesce("title", "t").alias("title"), F.coalesce("year", "y").alias("year"), F.coalesce("genre", "g").alias("genre"), F.array_union(F.coalesce("flags", none), F.coalesce("f", none)).alias("flags"))


def add_aliases(have: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, index) after new ones (author, work_id, alias, seq): aliases (author, work_id, alias) united; index (author, title_key, work_id), in which the first owner of a key keeps it: titles before aliases, then the order of seq. `have` holds (author, work_id, title, aliases)."""
    old = have.select("author", "work_id", F.posexplode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "alias"))
    rows = old.select("author", "work_id", "alias", (F.col("at") == 0).alias("own"), F.col("at").cast("long").alias("seq"), F.lit(0).alias("late")).union(
        new.join(have.select("author", "work_id"), ["author", "work_id"], "left_semi").select("author", "work_id", "alias", F.lit(False), F.col("seq").cast("long"), F.lit(1))
    )
    keyed = rows.withColumn("title_key", normal_title(nfc(F.col("alias")))).where("title_key <> ''")
    index = keyed.groupBy("author", "title_key").agg(F.min_by("work_id", F.struct((~F.col("own")).alias("o"), "late", "seq", "work_id")).alias("work_id"))
    return rows.where("not own").select("author", "work_id", "alias").distinct(), index


def seed_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(author, n_added, n_updated): works that seeding added, and those whose year, genre or flags it filled."""
    b = before.select("author", "work_id", F.struct("year", "genre", F.array_sort("flags")).alias("was"))
    j = after.select("author", "work_id", F.struct("year", "genre", F.array_sort("flags")).alias("now")).join(b, ["author", "work_id"], "left")
    new = F.col("was").isNull()
    return j.groupBy("author").agg(F.sum(new.cast("long")).alias("n_added"), F.sum((~new & ~F.col("was").eqNullSafe(F.col("now"))).cast("long")).alias("n_updated"))


def one_edition(records: DataFrame, key: str, work: str) -> DataFrame:
    """The record to pull of each work: the earliest year, records without one last, then the smallest key."""
    first = F.min_by(key, F.struct(F.col("year").isNull().alias("no"), "year", key))
    return records.where(F.col(work).isNotNull()).groupBy(work).agg(first.alias(key), F.count(F.lit(1)).alias("n_editions"))


def add_sources(have: DataFrame, refs: DataFrame) -> DataFrame:
    """Source references (author, work_id, source, id, status, year, note) folded by source and id: ingested is never downgraded, otherwise the later status, year and note win where given. `seq` orders the new ones."""
    both = have.withColumn("seq", F.lit(-1).cast("long")).unionByName(refs)
    rank = F.struct((F.col("status") == "ingested").alias("i"), F.col("seq").alias("s"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("seq"))).alias(c)
    return both.groupBy("author", "work_id", "source", "id").agg(F.max_by("status", rank).alias("status"), last("year"), last("note"))


def status(refs: Column, flags: Column) -> Column:
    """Coverage of a work from its array of source references, by priority."""
    has = lambda f: F.exists(refs, f)
    got = F.array_sort(F.array_distinct(F.transform(F.filter(refs, lambda r: r.status == "ingested"), lambda r: r.source)))
    skipped = F.array_sort(F.filter(F.transform(refs, lambda r: r.status), lambda s: s.startswith("skipped")))
    return (
        F.when(F.array_contains(flags, "not_by_author"), "excluded").when(F.size(got) > 0, F.concat(F.lit("ingested ("), F.array_join(got, "+"), F.lit(")")))
        .when(has(lambda r: r.status == "candidate"), "candidate").when(F.size(skipped) > 0, F.try_element_at(skipped, F.lit(1))).otherwise("missing")
    )


def collisions(works: DataFrame) -> DataFrame:
    """(title_key, n_authors, authors) of titles that works of two or more authors share."""
    k = works.select("author", normal_title(nfc(F.col("title"))).alias("title_key")).where("title_key <> '' and author is not null").distinct()
    return k.groupBy("title_key").agg(F.count(F.lit(1)).alias("n_authors"), F.array_sort(F.collect_list("author")).alias("authors")).where("n_authors > 1")


def violations(works: DataFrame, first: int, last: int) -> DataFrame:
    """(author, work_id, problem): ids that don't fit the title, titles that repeat, years outside the range."""
    w = works.withColumn("_k", title_key(F.col("title"), F.col("author")))
    wrong = w.where(slug(F.col("_k")) != F.col("work_id")).select("author", "work_id", F.lit("id").alias("problem"))
    twice = w.groupBy("author", "_k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = w.join(twice, ["author", "_k"]).select("author", "work_id", F.lit("title").alias("problem"))
    year = w.where((F.col("year") < first) | (F.col("year") > last)).select("author", "work_id", F.lit("year").alias("problem"))
    return wrong.union(again).union(year)


def by_author(creators: Column, people: Column, title: Column, query: Column) -> Column:
    """Layered authorship of a library record for 'Surname, Given': creators decide where there are any; else people by surname, unless the title attributes the work to someone else or is a memorial."""
    q = casefold(query)
    surname = strip(F.try_element_at(F.split(q, ","), F.lit(1)))
    none = F.array().cast("array<string>")
    made = F.exists(F.coalesce(creators, none), lambda x: F.startswith(casefold(x), q))
    named = F.exists(F.coalesce(people, none), lambda x: F.contains(casefold(x), surname))
    t = F.coalesce(title, F.lit(""))
    tail = casefold(F.regexp_extract(t, ATTRIBUTION + "(.*)$", 2))
    foreign = F.rlike(t, F.lit(ATTRIBUTION)) & ~F.contains(tail, surname)
    return F.when(F.size(F.coalesce(creators, none)) > 0, made).otherwise(named & ~foreign & ~F.rlike(t, F.lit(MEMORIAL)))


def match_titles(records: DataFrame, key: str, title: str, author: str, works: DataFrame) -> DataFrame:
    """(key, work_id): the work a record's title names, whole first, then part by part from the head."""
    parts = F.concat(F.array(F.col(title)), F.filter(F.split(F.col(title), SEPARATOR), lambda s: s != ""))
    p = records.where(F.col(title).isNotNull()).select(key, F.col(author).alias("_a"), F.posexplode(parts).alias("pos", "part")).withColumn("_k", title_key(F.col("part"), F.col("_a")))
    w = works.select(F.col("author").alias("_a"), "work_id", title_key(F.col("title"), F.col("author")).alias("_k"))
    return p.join(w, ["_a", "_k"]).groupBy(key).agg(F.min_by("work_id", F.struct("pos", "work_id")).alias("work_id"))


def bucket(by: Column, types: Column, langs: Column, rights: Column, text_url: Column, work: Column, own: Column, covered: Column, home: str = "slv") -> Column:
    """What becomes of a library record; the first that holds."""
    fold = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), casefold)
    scan = F.exists(fold(types), lambda t: t.isin("rokopis", "rokopisi"))
    return (
        F.when(~F.coalesce(by, F.lit(False)), "not_author").when(scan, "manuscript").when((F.size(fold(langs)) > 0) & ~F.array_contains(fold(langs), home), "not_slovene")
        .when(~F.contains(F.coalesce(rights, F.lit("")), F.lit(RIGHTS_FREE)), "in_copyright").when(text_url.isNull(), "pd_no_text").when(work.isNull(), "pd_unmatched")
        .when(own, "pd_ingested").when(covered, "pd_covered").otherwise("pd_unpulled")
    )


def catalog(pages: DataFrame, key: str, wikitext: str, not_works: tuple[str, ...] = ()) -> DataFrame:
    """(key, line, title, year, genre, alias_of, translated) of the entries of catalogue pages; genre is the section an entry stands in."""
    none = F.array(*[F.lit(x) for x in not_works]) if not_works else F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        sec, entry = F.regexp_extract(s, SECTION, 1), F.regexp_extract(s, ENTRY, 1)
        genre = F.when(sec == "", acc.genre).when(F.array_contains(none, casefold(sec)), F.lit(None)).otherwise(sec)
        row = F.struct(acc.line.alias("line"), F.btrim(entry).alias("title"), F.regexp_extract(s, ENTRY, 2).alias("tail"), genre.alias("genre"))
        rows = F.when((sec == "") & (entry != ""), F.concat(acc.rows, F.array(row))).otherwise(acc.rows)
        return F.struct((acc.line + 1).alias("line"), genre.alias("genre"), rows.alias("rows"))

    zero = F.struct(F.lit(0).alias("line"), F.lit(None).cast("string").alias("genre"), F.array().cast("array<struct<line:int,title:string,tail:string,genre:string>>").alias("rows"))
    found = F.aggregate(F.split(F.col(wikitext), r"\r\n|\n"), zero, step, lambda a: a.rows)
    e = pages.where(F.col(wikitext).isNotNull()).select(key, F.explode(found).alias("e"))
    year, see = F.regexp_extract("e.tail", YEAR, 1), F.btrim(F.regexp_extract("e.tail", SEE, 1))
    translated = F.contains("e.tail", F.lit("(prevod)")) | F.endswith("e.title", F.lit("(prevod)"))
    return e.select(key, "e.line", "e.title", F.when(year != "", year.cast("int")).alias("year"), "e.genre", F.when(see != "", see).alias("alias_of"), translated.alias("translated"))
