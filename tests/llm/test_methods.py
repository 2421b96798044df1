"""The methods against brute force, exact round trips and held-out accuracy."""

import heapq
import itertools
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zrno.llm import boost, defects, grams, levels, mixing, mojibake, near, packing, queries, scans, spans, splits

DATA = "/root/testdata/sf0.001"
HAVE = os.path.isdir(DATA)


def random_docs(n=60, seed=3):
    r = random.Random(seed)
    vocab = [f"beseda{i}" for i in range(400)]
    rows, bases = [], []
    for i in range(n):
        kind = r.random()
        if bases and kind < 0.5:
            w = list(r.choice(bases))
            for _ in range(r.randint(0, 12)):
                w[r.randrange(len(w))] = r.choice(vocab)
            if kind < 0.15:
                w = w[: len(w) // 2] + [r.choice(vocab) for _ in range(40)]
        else:
            w = [r.choice(vocab) for _ in range(r.randint(20, 90))]
            bases.append(w)
        rows.append((i + 1, " ".join(w)))
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1].upper())]
    return rows


# --- pairs with defects


def test_refusals_only_outside_speech():
    src = "Dobri mlinar je šel v mlin. „Žal ti ne morem pomagati,“ reče starec."
    assert not defects.is_refusal(src, "Dobri mlinar je odšel v mlin. „Žal ti ne morem pomagati,“ pravi starec.")
    for s in ("Žal tega besedila ne morem prepisati.", "I'm sorry, but I can't rewrite this passage.", "Leider kann ich diesen Abschnitt nicht umschreiben.", "Nažalost ne mogu preraditi ovaj tekst.", "Je ne peux pas réécrire ce texte."):
        assert defects.is_refusal(src, "Mlinar gre v mlin. " + s), s


def test_copies_and_endings():
    src = "Čez cesto gre mačka. Pes jo vidi in zalaja nanjo prav glasno sredi noči."
    assert defects.is_copy(src, "Odgovor: **cez  cesto gre MACKA; pes jo vidi in zalaja nanjo\nprav glasno sredi noci**")
    assert not defects.is_copy(src, "Čez cesto gre mačka. Pes jo vidi in laja.")
    assert defects.is_truncated(src, "Čez cesto gre mačka. Pes jo vidi in zalaja nanjo prav gla")
    assert not defects.is_truncated(src, "Mačka gre čez cesto. Pes jo opazi in zalaja nanjo prav glasno sredi noči.")
    assert not defects.is_truncated(src.rstrip("."), "Čez cesto gre mačka. Pes jo vidi in zalaja nanjo prav glasno sredi noči")
    assert defects.is_empty("„“ … ") and defects.is_empty("(brez besedila)") and not defects.is_empty("Nič.")


def test_foreign_sentences_count_by_letters():
    assert defects.foreign_share("Domače besede. Foreign words here", {"foreign", "words", "here"}) > 0.5


def test_refusals_in_many_languages():
    for s in ("No puedo reescribir este texto.", "К сожалению, я не могу переписать этот текст.", "Niestety nie mogę przepisać tego fragmentu.", "Bohužel nemohu text přepsat, žádost odmítám.", "Sajnos nem tudom átírni ezt a szöveget.", "Não posso reescrever este trecho.", "Ik kan deze tekst helaas niet herschrijven.", "Нажалост, не могу да препишем овај текст.", "Jag kan tyvärr inte skriva om texten.", "Nu pot rescrie acest text."):
        assert defects.is_refusal("Mlinar gre v mlin.", s), s
    assert all(k in defects.TRIGGERS for k in defects.REFUSALS)


def test_open_delimiters_scripts_and_prefixes():
    src = "Mlinar reče: „Pojdi domov (po stari cesti) in ne oziraj se več.“ Potem gre spat in dolgo spi do jutra."
    assert defects.unclosed(src, "Mlinar reče: „Pojdi domov") and defects.unclosed(src, "Pojdi (po cesti.") and not defects.unclosed(src, src)
    assert not defects.unclosed("Mlinar reče: „Pojdi", "Mlinar pravi: „Pojdi")  # left open by the source too
    assert defects.is_truncated(src, "Mlinar pravi: „Pojdi domov (po stari cesti) in ne oziraj se več. Potem gre spat")
    assert defects.is_truncated("", "Potem je mlinar rekel (zelo tiho") and not defects.is_truncated("", "Potem je mlinar rekel zelo tiho")
    assert defects.new_scripts("Mlin", "Мельница") and not defects.new_scripts("Мельница", "Мельница") and not defects.new_scripts("a", "čšž")
    a, b = defects.fold(src), defects.fold(src[:60] + " pa se je vse končalo čisto drugače kakor prej.")
    assert defects.copied_prefix(a, b) and not defects.copied_prefix(a, a) and not defects.copied_prefix(a, defects.fold("Nekaj povsem drugega."))


def test_every_defect_is_reported(spark):
    src = "Stara hiša stoji ob vodi in mlinar hodi po cesti do mlina. Mlada žena čaka pred vrati, otrok pa spi v topli sobi do jutra."
    rows = [(i, src, "Hiša stoji ob vodi in mlinar gre po cesti do mlina. Žena čaka pred vrati, otrok spi v topli sobi do jutra.", 40) for i in range(20)]
    rows += [(30, src, "Старый дом стоит у воды, мельник идёт по дороге к мельнице. Молодая жена ждёт у ворот.", 40), (31, src, src[:70] + " odšel je drugam in tam čakal na boljše čase, a jih ni bilo.", 40), (32, src, rows[0][2], 4000), (33, src, None, None)]
    got = {r[0]: set(r[1]) for r in defects.flag_pairs(spark.createDataFrame(rows, "k long, s string, r string, t long"), "k", "s", "r", "t").collect()}
    assert got[0] == set() and {"script_mismatch", "other_language"} <= got[30] and "copied_prefix" in got[31] and got[32] == {"token_misfit"} and got[33] == {"empty"}


def test_one_pair_alone(spark):
    src = "Stara hiša stoji ob vodi in mlinar hodi po cesti do mlina, kjer čaka žena."
    got = defects.flag_pairs(spark.createDataFrame([(1, src, "Stara hiša stoji ob vodi in mlinar koraka po ulici proti mlinu, kjer čaka soproga.")], "k long, s string, r string"), "k", "s", "r").collect()
    assert got[0].defects == []


# --- splits


@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from("ab"), st.integers(1, 40)), min_size=1, max_size=12, unique_by=lambda x: x[:2]))
@settings(max_examples=40, deadline=None)
def test_allocation_is_whole_and_near_its_quotas(bundles):
    got, _ = splits.allocate(bundles, {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert all(sum(got[s, x]) == n for s, x, n in bundles)
    total, big = sum(s * n for s, _, n in bundles), max(s for s, _, _ in bundles)
    for k, q in enumerate((0.8, 0.1, 0.1)):
        assert abs(sum(s * got[s, x][k] for s, x, _ in bundles) - q * total) <= 3 * big + 2


def test_heavy_components_are_in_the_flow():
    heavy = [(3000, "a"), (1200, "b"), (900, "a"), (700, "b"), (400, "a")]
    bundles = [(1, "a", 2000), (1, "b", 1500), (7, "b", 40), (20, "a", 1)]
    got, where = splits.allocate(bundles, {"train": 0.8, "validation": 0.1, "test": 0.1}, heavy)
    total = sum(n for n, _ in heavy) + sum(s * n for s, _, n in bundles)
    for k, q in enumerate((0.8, 0.1, 0.1)):
        assert abs(sum(n for (n, _), w in zip(heavy, where) if w == k) + sum(s * got[s, x][k] for s, x, _ in bundles) - q * total) <= 20
    assert where[0] == where[1] == 0  # larger than the small quotas


def test_very_many_bundles_are_fast():
    r = random.Random(1)
    sizes = {(r.randint(1, 10**6), f"p{r.randrange(200)}"): r.randint(1, 50) for _ in range(100_000)}
    t = time.time()
    got, _ = splits.allocate([(s, x, n) for (s, x), n in sizes.items()], {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert time.time() - t < 60 and all(sum(got[k]) == n for k, n in sizes.items())
    total = sum(s * n for (s, _), n in sizes.items())
    assert all(abs(sum(s * x[k] for (s, _), x in got.items()) / total - q) < 0.001 for k, q in enumerate((0.8, 0.1, 0.1)))


def test_flow_finds_the_least_cost():
    r = random.Random(1)
    for _ in range(20):
        f = splits.Flow(6)
        cost = {(i, j): r.randint(0, 9) for i in (2, 3) for j in (4, 5)}
        for i in (2, 3):
            f.arc(0, i, 1, 0)
            f.arc(i + 2, 1, 1, 0)
        for (i, j), c in cost.items():
            f.arc(i, j, 1, c)
        assert f.solve(0, 1) == min(cost[2, 4] + cost[3, 5], cost[2, 5] + cost[3, 4])


def test_names_and_pages():
    same = ["Črt Zgobulj", "ZGOBULJ, Črt", "Zgobulj Črt", "Zgobulj, Črt, 1892-1975", "Črt Zgobulj (1892–1975)", "  Črt   Zgobulj "]
    assert len({splits.name_keys(x)[0] for x in same}) == 1
    assert splits.name_keys("Crt Zgobulj")[1] == splits.name_keys("Črt Zgobulj")[1]
    assert splits.name_keys("Zgobulj, Č.")[0] == splits.name_keys("Č. Zgobulj")[0] and not splits.name_keys("N. N.") and not splits.name_keys("—")
    pages = ["https://sl.x.example/wiki/Črni_prag_(0039gz)", "HTTPS://SL.m.x.example/wiki/%C4%8Crni_prag_(0039gz)?oldid=7#a", "http://sl.x.example/w/index.php?title=Črni_prag_(0039gz)", "https://sl.x.example/wiki/Črni prag_(0039gz)/"]
    assert len({splits.page_of(p) for p in pages}) == 1
    assert splits.page_of("https://www.d.example/details/URN:NBN:XX:DOC-1A/") == splits.page_of("http://d.example/stream/urn:nbn:xx:doc-1a/TEXT")


# --- garbled text

CLEAN = "Široka čaša žvenketa na mizi ter mačka počasi šepeta žalostno zgodbo o hiši, ki še stoji sredi češnjevega vrta. »Žal,« reče mož."


@pytest.mark.parametrize("written,read", [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "cp1250"), ("cp1250", "latin-1"), ("cp1250", "cp852"), ("utf-8", "cp852"), ("utf-8", "cp1251")])
def test_garbling_is_undone(spark, written, read):
    words = CLEAN.split()
    r = random.Random(5)
    rows = [(i, " ".join(r.sample(words, len(words)))) for i in range(60)] + [(100, "Ob jedi so si želeli »crème brûlée« in »façade«, beseda Größe pa stoji poleg črke Ä sama.")]
    raw = "".join(mojibake._read(c.encode(written, "replace"), read, False) if not c.isascii() else c for c in CLEAN)
    rows.append((200, raw))
    got = {x.id: x for x in mojibake.restore(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert set(got) == {200}
    if written == "utf-8":
        assert got[200].restored == CLEAN


def test_foreign_words_are_garbled_by_their_bytes():
    g = mojibake.Garble()
    for w in ("perché", "»правда", "λόγος", "naïve", "§"):
        x = w.encode().decode("latin-1")
        assert g.suspect(x) and g.strict(x)[0] == w, w
        assert g.strict(w) is None
    assert g.strict("Größe") is None and g.strict("ČŠŽ čšž") is None and g.strict("Ä") is None


def test_limits_come_from_all_counts():
    counts = {("strong", 300): 999, ("strong", 30): 1, ("weak", 90): 50, ("quality", -400): 9, ("quality", -900): 1}
    got = mojibake.limits_of(counts)
    assert got["strong_margin"] == 10.0 and got["weak_margin"] == 3.0 and got["strong_recall"] == 0.999 and got["weak_recall"] == 1.0
    assert got["floor"] == -9.0 and got["weak_floor"] == -4.0
    none = mojibake.limits_of({})
    assert none["strong_margin"] == 2.0 and none["weak_recall"] == 1.0


def test_division_marks_are_no_garbling(spark):
    rows = [(i, "Široka čaša žvenketa na mi¬\nzi ter mačka počasi šepe¬\nta žalostno zgodbo o hiši.") for i in range(40)]
    assert mojibake.restore(spark.createDataFrame(rows, "id long, text string"), "id", "text").count() == 0


# --- spans and near duplicates


def test_window_kernels():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 60, 500).astype(np.uint64)
    assert (grams.window_minima(x, 9) == np.array([x[i : i + 9].min() for i in range(492)])).all()
    text = "".join(random.Random(2).choice("abč𝄞") for _ in range(700)) * 2
    codes, _ = grams.code_points([text])
    h = grams.window_hashes(codes, 12)
    by = {}
    for i in range(len(text) - 11):
        by.setdefault(text[i : i + 12], set()).add(int(h[i]))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


@pytest.mark.parametrize("hot", [0, 4096])
def test_spans_match_brute_force(spark, hot):
    rows = random_docs() + [(900, "ab" * 40_000), (901, "x" + "ab" * 300)]
    span = 60
    sets = {i: {t[k : k + span] for k in range(len(t) - span + 1)} for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}
    d = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got = {(r.a, r.b) for r in near.expand(*spans.shared_pairs(d, "id", "text", span=span, mini=20, hot=hot)).collect()}
    assert got == want
    share = {r.id: r.shared_chars for r in spans.shared_share(d, "id", "text", span=span, mini=20, hot=hot).collect()}
    for i, t in rows:
        cover = np.zeros(len(t), bool)
        others = set().union(*(s for j, s in sets.items() if j != i))
        for k in range(len(t) - span + 1):
            if t[k : k + span] in others:
                cover[k : k + span] = True
        assert share.get(i, 0) == cover.sum(), i


def test_windows_are_checked_against_the_strings(monkeypatch):
    strings = ["abcabcabcabdxyz" * 3, "zzabcabcabcabd", "abc" * 9, "q"]
    n, span = [max(0, len(s) - 5) for s in strings], 6
    for spoil in (False, True):
        if spoil:  # hashes of one value for all windows
            monkeypatch.setattr(spans.grams, "mix", lambda x: np.zeros(len(x), np.uint64))
        row, off, run = spans.equal_windows(np.zeros(4, np.int64), strings, span)
        assert len(row) == sum(n) and sorted(zip(row, off)) == [(i, k) for i in range(4) for k in range(n[i])]
        by = {}
        for r, o, k in zip(row, off, run):
            by.setdefault(int(k), set()).add(strings[r][o : o + span])
        assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_one_passage_in_every_text_is_linear(spark):
    p = "Stara hiša stoji ob vodi in stari mož počasi hodi po cesti, mlada žena čaka pred vrati, otrok pa spi v topli sobi. "
    rows = [(i, f"beseda{i * 7919} " * 12 + p + f"reka{i * 104729} " * 12) for i in range(400)]
    d = spark.createDataFrame(rows, "id long, text string")
    for hot in (8, 4096):
        _, groups = spans.shared_groups(d, "id", "text", span=80, mini=20, hot=hot)
        assert groups.where("g is not null").groupBy("g").count().agg({"count": "max"}).first()[0] == 400 and groups.count() < 20 * 400
        assert spans.shared_pairs(d, "id", "text", span=80, mini=20, hot=hot)[1].count() == 400 * 399 // 2


def test_a_passage_that_a_third_of_all_share(spark):
    p = "Stara hiša stoji ob vodi in stari mož počasi hodi po cesti, mlada žena čaka pred vrati, otrok pa spi v topli sobi. "
    rows = [(i, (p if i % 3 == 0 else "") + f" beseda{i * 7919}" * 30) for i in range(900)]
    got = {r.id: r.shared_chars for r in spans.shared_share(spark.createDataFrame(rows, "id long, text string"), "id", "text", span=80, mini=20).collect()}
    assert {i for i, n in got.items() if n} == set(range(0, 900, 3)) and all(n >= len(p) for n in got.values() if n)


def test_boilerplate_makes_no_candidates(spark):
    r = random.Random(8)
    common = " ".join(f"skupna{i}" for i in range(40))
    rows = [(i, " ".join(f"beseda{r.randrange(10**6)}" for _ in range(60)) + " " + common) for i in range(300)] + [(900 + i, f"{common} dodatek{i}") for i in range(3)]
    _, pairs = near.near_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text", least=0.5, weighted=False, hot=5)
    assert {(x.a, x.b) for x in pairs.collect()} == {(900, 901), (900, 902), (901, 902)}


@pytest.mark.parametrize("hot", [0, 2048])
@pytest.mark.parametrize("weighted", [False, True])
def test_near_pairs_match_brute_force(spark, weighted, hot):
    from collections import Counter

    rows = random_docs()
    bags = {}
    for i, t in rows:
        w = grams.WORD.findall(t.lower())
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        bags[i] = c if weighted else Counter(set(c))
    sim = lambda a, b: sum((a & b).values()) / sum((a | b).values())
    want = {(a, b) for a, b in itertools.combinations(sorted(bags), 2) if sim(bags[a], bags[b]) >= 0.5}
    d = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {(r.a, r.b) for r in near.expand(*near.near_pairs(d, "id", "text", 0.5, weighted=weighted, hot=hot)).collect()}
    assert got == want
    only = {x for x, t in rows if x <= 60}
    exact = near.exact_pairs(d.where("id <= 60"), "id", "text", 0.5, weighted=weighted)
    assert {(r.a, r.b) for r in exact.collect()} == {(a, b) for a, b in want if a in only and b in only}


def test_bag_signatures_are_unbiased():
    r = np.random.default_rng(0)
    e = r.integers(0, 1 << 62, 200).astype(np.uint64)
    w1, w2 = r.integers(1, 20, 200), r.integers(1, 20, 200)
    s = grams.bag_minhash(np.repeat([0, 1], 200), np.concatenate([e, e]), np.concatenate([w1, w2]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.03


# --- scanned pages


def test_lines_of_pages():
    text = "Stara hiša stoji ob široki cesti in stari mlinar\nže dolgo sedi pred njo ter gleda prav pre-\n- 12 -\nVEČERNI LISTEK\nlepo dolino, ki se vleče tja proti severno-\nzahodni meji in dalje.\n\n1875\nMlin je pogorel."
    x = scans.Layout(text, [], {})
    assert [s for s, p in zip(x.lines, x.page) if p] == ["- 12 -"] and [s for s, h in zip(x.lines, x.head) if h] == ["VEČERNI LISTEK"]
    body = [s for s, e in zip(x.lines, x.edges()) if not e]
    got = scans.join_divided(body, lambda a, mark, b: "-" if scans.parts_of_word(a, b) == ("severno", "zahodni") else "")
    assert "prav prelepo" in got[1] and any("severno-zahodni" in s for s in got)
    assert scans.paragraphs(got).count("\n\n") == 1
    assert scans.page_number("Stran l2") == 12 and scans.page_number("[7]") == 7 and scans.page_number("lil") is None and scans.page_number("leta 1875") is None


def test_misread_words_are_corrected(spark):
    words = [("mladost", 400), ("m1adost", 2), ("mokro", 300), ("molcro", 3), ("sanja", 50), ("hiša", 90), ("hisa", 2), ("cesta", 80), ("mesta", 70), ("zvon", 30)]
    got = dict(scans.corrections(spark.createDataFrame(words, "word string, n long")).collect())
    assert got == {"m1adost": "mladost", "molcro": "mokro", "hisa": "hiša"}


def test_division_by_counts_of_both_ways(spark):
    words = spark.createDataFrame([("prelepo", 1), ("severno-zahodni", 1), ("gozd", 9), ("dolina", 9), ("pre", 50)], "word string, n long")
    pairs = spark.createDataFrame([("pre", "lepo"), ("severno", "zahodni"), ("gozd", "dolina"), ("mla", "dost")], "a string, b string")
    assert {(r.a, r.joined) for r in scans.divided(pairs, words).collect()} == {("pre", True), ("severno", False), ("gozd", False), ("mla", True)}


def test_confusions_are_learnt(spark):
    r = random.Random(4)
    stems = ["".join(r.choice("aeio") if k % 2 else r.choice("bdgklmprstvz") for k in range(8)) for _ in range(120)]
    often = [(w[:3] + "h" + w[3:], 900) for w in stems[:60]] + [(w[:5] + "u" + w[5:], 700) for w in stems[60:]]
    rare = [(w[:3] + "b" + w[3:], 2) for w in stems[:25]] + [(w[:5] + "n" + w[5:], 2) for w in stems[60:80]]
    ends = [(w[:-1] + r.choice("aeiou"), 3) for w, _ in often[:60]]  # inflected words differ at their ends
    words = spark.createDataFrame(sorted({**dict(ends), **dict(rare), **dict(often)}.items()), "word string, n long")
    got = scans.confusions(words)
    assert set(got[len(scans.CONFUSIONS) :]) == {("b", "h"), ("n", "u")}
    right = dict(scans.corrections(words, pairs=got).collect())
    assert all(right[w] == o for (w, _), (o, _) in zip(rare[:25], often)) and all(w in right for w, _ in rare)


def test_headers_of_many_works_and_misread_ones(spark):
    body = "Stara hiša stoji ob široki cesti in stari mlinar že\ndolgo sedi pred njo ter gleda lepo dolino, ki se vleče.\n"
    rows = [(i * 100 + k, f"{body}- {k + 7} -\nVečerni zvon {'abcdefgh'[i % 8]}{'xyzw'[i // 8]}\n{body}") for i in range(30) for k in range(6)]
    rows += [(9000 + i, f"{body}Večerni zv0n {'abcdefgh'[i % 8]}{'xyzw'[i // 8]}\n{body}") for i in range(30)] + [(9999, f"{body}Povsem druga vrsta\n{body}")]
    d = spark.createDataFrame([(i, t, None, None) for i, t in rows], "id long, text string, title string, author string")
    heads = {r.id for r in scans.noise(d, "id", "text", "title", "author").where("noise = 'header'").collect()}
    assert heads == {i for i, _ in rows} - {9999}


# --- packing and mixing


@given(st.lists(st.integers(0, 900), max_size=60))
@settings(max_examples=60, deadline=None)
def test_packing_loses_nothing(sizes):
    vec = [np.arange(i % 7, i % 7 + 5, dtype=np.uint32).tobytes() + np.ones(5, np.uint32).tobytes() for i in range(len(sizes))]
    rows, fill = packing.pack_shard(np.array(sizes, np.int64), packing.Index(vec), 256)
    by = {}
    for d, _, c, n, _ in rows:
        by[c] = by.get(c, 0) + n
    assert all(by[c] == fill[c] <= 256 for c in by)
    for d, n in enumerate(sizes):
        mine = [r for r in rows if r[0] == d]
        assert sum(r[3] for r in mine) == n and (n > 256 or len(mine) <= 1)
    assert sum(f <= 128 for f in fill) <= 1 and len(fill) <= 2 * -(-sum(sizes) // 256) + 1


def test_neighbours_share_their_seeds_container():
    r = np.random.default_rng(5)
    kinds = [np.arange(k * 50, k * 50 + 40, dtype=np.uint32) for k in range(6)]
    of = [int(r.integers(6)) for _ in range(300)]
    vec = [kinds[k].tobytes() + np.ones(40, np.uint32).tobytes() for k in of]
    rows, fill = packing.pack_shard(r.integers(20, 120, 300), packing.Index(vec), 256)
    seeds = {c: d for d, _, c, _, near in reversed(rows) if not near}
    near = [(d, c) for d, _, c, _, x in rows if x]
    assert len(near) > 100 and all(of[d] == of[seeds[c]] for d, c in near)
    assert len(fill) <= 1.05 * sum(fill) / 256 + 1


def test_bm25_prefers_the_like():
    a, b = np.arange(10, dtype=np.uint32), np.arange(100, 110, dtype=np.uint32)
    vec = [x.tobytes() + np.ones(10, np.uint32).tobytes() for x in (a, b, a, b)]
    s = packing.Index(vec).scores(0)
    assert s[2] > s[1] == s[3] == 0


def test_bm25_scores_by_all_terms():
    r = np.random.default_rng(1)
    docs = [np.sort(r.choice(300, 100, replace=False)).astype(np.uint32) for _ in range(200)]
    tf = [r.integers(1, 5, 100).astype(np.uint32) for _ in docs]
    index = packing.Index([d.tobytes() + c.tobytes() for d, c in zip(docs, tf)])
    df = np.bincount(np.concatenate(docs), minlength=300)
    idf, mean = np.log1p((200 - df + 0.5) / (df + 0.5)), np.mean([c.sum() for c in tf])
    for i in (0, 7, 199):
        want = [sum(idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * cs.sum() / mean)) for t, c in zip(d, cs.astype(float)) if t in set(docs[i])) for d, cs in zip(docs, tf)]
        assert df[docs[i]].sum() > 4096 and np.allclose(index.scores(i), want, rtol=1e-4)


@given(st.lists(st.floats(0.01, 1), min_size=1, max_size=6), st.integers(0, 60), st.lists(st.integers(0, 40), min_size=6, max_size=6))
@settings(max_examples=150, deadline=None)
def test_seats_go_by_the_highest_quotients(weights, seats, caps):
    caps = caps[: len(weights)]
    got = mixing.sainte_lague(weights, seats, caps)
    heap, want = [(-w, i) for i, w in enumerate(weights) if caps[i]], [0] * len(weights)
    heapq.heapify(heap)
    for _ in range(min(seats, sum(caps))):
        q, i = heapq.heappop(heap)
        want[i] += 1
        if want[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * want[i] + 1), i))
    assert sum(got) == sum(want)
    q = lambda v, i: weights[i] / (2 * v + 1)
    assert all(q(got[i] - 1, i) >= q(got[j], j) * (1 - 1e-9) for i in range(len(weights)) for j in range(len(weights)) if got[i] and got[j] < caps[j])


def test_blocks_make_up_what_is_wanted():
    r = np.random.default_rng(2)
    for _ in range(50):
        sizes = r.integers(1, 5000, r.integers(1, 200))
        want = int(r.integers(0, 3 * sizes.sum()))
        got = mixing.chosen(sizes, want, 7)
        assert got.max() - got.min() <= 1 and abs(int((got * sizes).sum()) - want) <= sizes.max() / 2 + 1
        assert (got == mixing.chosen(sizes, want, 7)).all()


def test_mix_in_groups_of_shards(spark):
    words = "ena dva tri štiri pet šest sedem osem devet deset".split()
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(5, 60))), "ab"[i % 3 > 0]) for i in range(3000)], "id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.6, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, targets, "id", "text", "source", block=64, shard_tokens=2000, group=8)
    got = {x.source: x.actual_share for x in mixing.shares(m, targets).collect()}
    assert abs(got["a"] - 0.4) < 0.01 and m.agg({"copies": "max"}).first()[0] <= 2


@pytest.mark.skipif(not HAVE, reason="no test tables")
def test_mix_reaches_its_shares(spark):
    from zrno.session import table

    at = DATA.replace("0.001", "0.01")
    q = queries.QUERIES["p8_shares"](spark, at).collect()
    most = {r.source: r.max_repeats for r in table(spark, at, "mix_targets").collect()}
    assert all(r.most_copies <= most[r.source] for r in q)
    free = [r for r in q if r.n_docs and r.most_copies < most[r.source] and r.n_tokens > 20_000]
    assert abs(sum(r.actual_share for r in q) - 1) < 1e-9 and free
    up = [r.actual_share / r.target_share for r in free]
    assert max(up) / min(up) < 1.05


# --- levels


def test_trees_learn():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0) + 0.05 * r.normal(size=2000)
    t = boost.Trees().fit(x[:1500], y[:1500])
    assert np.mean((t.predict(x[1500:]) - y[1500:]) ** 2) < 0.1 * np.var(y)


@pytest.mark.skipif(not HAVE, reason="no test tables")
def test_levels_hold_on_other_sources(spark):
    from pyspark.sql import functions as F

    from zrno.session import table

    d = "/root/testdata/sf0.1"
    g = levels.train_grader(table(spark, d, "documents").select("doc_id", "text", "source"), table(spark, d, "level_labels"), "doc_id", "text", "source", most=500)
    assert g.accuracy > 0.85  # out of fold, by source
    assert F is not None


def test_passages_lose_no_text():
    t = "Prva poved. Druga poved! Tretja?\n\nČetrta… " * 30
    assert "".join("".join(p) for p in levels.passages(t)).replace(" ", "") == t.replace(" ", "").replace("\n", "")


def test_batches_are_cut_by_size():
    b = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(["x" * 1000] * 10)], names=["id", "t"])
    parts = list(grams.chunks(iter([b]), 1, 2500))
    assert sum(p.num_rows for p in parts) == 10 and len(parts) > 2
