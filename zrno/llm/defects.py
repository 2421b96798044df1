"""Broken prompt and response pairs.

Ordered rules over each pair; every rule that fires is reported. Rules work on whole texts:

- empty: nothing is left of the response without blanks and marks, or it is a filler that stands for a text.
- refusal: outside quoted speech and outside what the source says itself, a clause joins a first-person negation with the task.
- copy: the folded source (letters and digits only, without case and letter marks) stands whole in the folded response.
- other_language: a third or more of the response's letters stand in foreign sentences, those with four in ten letters in
  foreign words or in a script that neither the language nor the source has. Foreign words are found by counting over all other
  pairs: a word is at home where sources, or responses that follow their source, use it at least as often as responses that don't;
  own source words are never foreign. A word that no other pair has is foreign in a response that doesn't follow its source; in one
  that does, only beside words of the sentence that are known to be foreign.
- truncated: aligned by the words that both sides have once, the response stops well before the source's end, or it ends
  without a final mark where the source has one, or within a bracket or quotation that the source closes.
- unclosed: a bracket or quotation is left open that the source does not leave open.
- script_mismatch: a tenth or more of the response's letters are of a script that neither the language nor the source has.
- copied_prefix: the response begins with two fifths or more of the folded source, word for word, but is no copy.
- token_misfit: the logged number of tokens is under half or over twice what a response of its length has by the median of all.

The first five decide what a pair is taken for; the others are evidence that is reported beside them.

Nulls: a null response is empty; a null source switches off copy, copied_prefix and the alignment, so that only an abrupt end within an
open delimiter counts as truncated; a null or negative token count fits. Null and repeated keys are kept as they are. Extra columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zrno.session import cut

#: Defects in the order in which one is chosen where several apply.
ORDER = ("empty", "refusal", "copy", "other_language", "truncated")

#: Fillers in place of a text, compared without case and outer marks.
FILLERS = ("null", "none", "nan", "nil", "n a", "na", "brez besedila", "brez odgovora", "prazno", "ni besedila", "no text", "empty", "kein text", "undefined", "tbd", "todo")

#: Per language, first-person negations and words of the task; a refusal has one of each in a sentence.
REFUSALS = {
    "sl": (r"ne (?:morem|smem|bom|zmorem|želim)|nisem (?:zmož|sposob|pooblašč)\w+|raje ne bi|moram (?:zavrniti|odkloniti)|(?:zavračam|odklanjam)", r"prošnj\w+|besedil\w+|vsebin\w+|nalog[aeio]\w*|odlom\w+|prepis\w+|preoblik\w+|posodob\w+|zahtev\w+|pomagati|sobesedil\w+"),
    "hr": (r"ne (?:mogu|smijem|želim)|neću|nisam u (?:mogućnosti|stanju)|moram odbiti", r"tekst\w*|zahtjev\w*|odlom\w+|sadržaj\w*|zadat\w+|pomoći|prepisati|preraditi|molb\w+"),
    "en": (r"(?:can|do|will|must|may)(?: ?not|n['’]t)|(?:won|can)['’]t|(?:unable|not able) to|have to (?:decline|refuse)|decline to", r"text|passage|content|request|excerpt|rewrit\w+|help|assist|moderni\w+|comply|task"),
    "de": (r"(?:kann|darf|werde|möchte|will|muss) (?:ich )?(?:\w+ ){0,8}?(?:nicht|keine?n?|ablehnen)", r"text\w*|abschnitt\w*|aufgabe\w*|anfrage\w*|inhalt\w*|umschreib\w+|helfen|bitte nicht|überarbeit\w+"),
    "fr": (r"(?:ne|n['’]) ?(?:peux|puis|suis|veux|vais) (?:pas|malheureusement)", r"texte|demande|passage|contenu|aider|réécrire|extrait"),
    "it": (r"non (?:posso|sono in grado|riesco)", r"testo|richiesta|brano|contenuto|aiutar\w+|riscriver\w+"),
    "es": (r"no (?:puedo|podré|quiero|debo|estoy en condiciones)|me niego|debo (?:rechazar|declinar)", r"texto|solicitud|petición|pasaje|contenido|ayudar\w*|reescrib\w+|fragmento|tarea"),
    "pt": (r"não (?:posso|consigo|devo|quero)|recuso", r"texto|pedido|trecho|conteúdo|ajudar|reescrev\w+|tarefa"),
    "nl": (r"(?:kan|mag|wil|zal) (?:ik )?(?:\w+ ){0,8}?(?:niet|geen)", r"tekst|verzoek|passage|inhoud|helpen|herschrijv\w+|taak"),
    "pl": (r"nie (?:mogę|potrafię|chcę|powinienem|jestem w stanie)|muszę odmówić|odmawiam", r"tekst\w*|prośb\w+|fragment\w*|treś\w+|pomóc|przepisa\w+|zadani\w+"),
    "cs": (r"(?:nemohu|nemůžu|nesmím|nechci|nedokážu|odmítám)|musím odmítnout", r"text\w*|žádost\w*|úryv\w+|obsah\w*|pomoci|pomoct|přeps\w+|úkol\w*"),
    "sk": (r"(?:nemôžem|nesmiem|nechcem|nedokážem|odmietam)|musím odmietnuť", r"text\w*|žiados\w+|úryv\w+|obsah\w*|pomôcť|prepísa\w+|úloh\w+"),
    "hu": (r"nem (?:tudom|tudok|szeretném|áll módomban)|vissza kell utasítanom", r"szöveg\w*|kérés\w*|részlet\w*|tartal\w+|segíten\w*|átír\w+|feladat\w*"),
    "ru": (r"(?:я )?не (?:могу|смогу|буду|хочу|в состоянии)|вынужден\w* отказать\w*|отказываюсь", r"текст\w*|запрос\w*|просьб\w+|отрыв\w+|содержани\w+|помочь|перепис\w+|задани\w+"),
    "sr": (r"не (?:могу|смем|смијем|желим)|нећу|морам (?:да )?одби\w+", r"текст\w*|захтев\w*|захтјев\w*|одлом\w+|садржај\w*|задат\w+|помо\w+|препи\w+"),
    "ro": (r"nu (?:pot|vreau|doresc|sunt în măsură)|trebuie să refuz", r"text\w*|cerer\w+|fragment\w*|conținut\w*|ajut\w*|rescri\w+|sarcin\w+"),
    "sv": (r"(?:kan|får|vill|kommer) (?:jag )?(?:\w+ ){0,4}?(?:inte|tyvärr)", r"text\w*|begäran|avsnitt\w*|innehåll\w*|hjälpa|skriva om|uppgift\w*"),
}
#: Words one of which every negation of a language holds: a text without them needs no closer look.
TRIGGERS = {
    "sl": "ne nisem raje moram zavračam odklanjam",
    "hr": "ne neću nisam moram",
    "en": "can cannot do donot don will willnot must mustnot mustn may maynot mayn won unable able have decline",
    "de": "kann darf werde möchte will muss",
    "fr": "ne n",
    "it": "non",
    "es": "no me debo",
    "pt": "não recuso",
    "nl": "kan mag wil zal",
    "pl": "nie muszę odmawiam",
    "cs": "nemohu nemůžu nesmím nechci nedokážu odmítám musím",
    "sk": "nemôžem nesmiem nechcem nedokážem odmietam musím",
    "hu": "nem vissza",
    "ru": "не вынужден вынуждена вынуждены отказываюсь",
    "sr": "не нећу морам",
    "ro": "nu trebuie",
    "sv": "kan får vill kommer",
}
_REFUSE = [(frozenset(TRIGGERS[k].split()), re.compile(rf"(?<!\w)(?:{a})(?!\w)", re.I), re.compile(rf"(?<!\w)(?:{b})(?!\w)", re.I)) for k, (a, b) in REFUSALS.items()]
#: Delimiters that are counted: what opens, what closes. A quotation that may open and close by the same mark counts by parity.
BRACKETS = (("(", ")"), ("[", "]"), ("{", "}"), ("»", "«"), ("„", "“”"))
#: Scripts of letters by ranges of code points; the language's own is Latin, as are all that is not listed.
SCRIPTS = {"greek": "\u0370-\u03ff\u1f00-\u1fff", "cyrillic": "\u0400-\u052f", "hebrew": "\u0590-\u05ff", "arabic": "\u0600-\u06ff\u0750-\u077f", "indic": "\u0900-\u0dff", "thai": "\u0e00-\u0eff", "georgian": "\u10a0-\u10ff", "cjk": "\u3040-\u30ff\u3400-\u9fff", "hangul": "\uac00-\ud7af"}
_SCRIPTS = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
_ANY_SCRIPT = re.compile("[" + "".join(SCRIPTS.values()) + "]")
_QUOTED = re.compile(r"„[^“”\"]*[“”\"]|»[^«]*«|“[^”]*”|\"[^\"]*\"")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_FINAL = re.compile(r"[.!?…][\s\"'“”«»)\]*_]*$")
_OPEN = re.compile(r"(?:…|\.\.\.|[-–—,;:])[\s\"'“”«»)\]*_]*$")


def fold(s: str) -> str:
    """Letters and digits only, without case and letter marks."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKD", s.casefold()))


def is_empty(response: str | None) -> bool:
    if response is None or not any(c.isalnum() for c in response):
        return True
    return len(response) < 40 and " ".join(re.findall(r"\w+", response.casefold())) in FILLERS


def is_refusal(source: str, response: str) -> bool:
    have = set(_WORD.findall(response.lower()))
    may = [(a, b) for w, a, b in _REFUSE if not have.isdisjoint(w)]
    said = _QUOTED.sub(" ", response) if may else ""
    may = [(a, b) for a, b in may if a.search(said) and b.search(said)]
    if not may:
        return False
    own = " ".join(source.split()).casefold()
    return any(any(a.search(s) and b.search(s) for a, b in may) and " ".join(s.split()).casefold() not in own for s in _SENTENCE.split(said))


def is_copy(source: str, response: str) -> bool:
    f = fold(source)
    return len(f) > 0 and f in fold(response)


def common_prefix(a: str, b: str) -> int:
    """Length of the common start, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def copied_prefix(a: str, b: str, least: float = 0.4, letters: int = 40) -> bool:
    """Whether the folded response b begins with `least` of the folded source a, and `letters` or more, before it departs from it."""
    n = common_prefix(a, b)
    return n < len(a) and n >= letters and n >= least * len(a)


def unclosed(source: str, response: str) -> bool:
    """Whether the response leaves more brackets or quotations of a kind open than its source does."""
    for o, c in BRACKETS:
        if o in response and (n := response.count(o) - sum(map(response.count, c))) > 0 and n > max(0, source.count(o) - sum(map(source.count, c))):
            return True
    return response.count('"') % 2 > source.count('"') % 2


def new_scripts(source: str, response: str) -> list[re.Pattern]:
    """Patterns of the scripts beyond the language's own that the response has and the source doesn't."""
    return [p for p in _SCRIPTS.values() if p.search(response) and not p.search(source)] if _ANY_SCRIPT.search(response) else []


def sentences(response: str) -> list[list[str]]:
    """Lower-case words of each sentence that has any."""
    return [w for part in _SENTENCE.split(response.lower()) if (w := _WORD.findall(part))]


def foreign_share(response: str, strange: set[str]) -> float:
    """Share of the response's letters in sentences that are foreign by their words."""
    all_n = foreign_n = 0
    for words in sentences(response):
        n = sum(map(len, words))
        all_n += n
        if sum(len(w) for w in words if w in strange) >= FOREIGN_WORDS * n:
            foreign_n += n
    return foreign_n / all_n if all_n else 0.0


def uncovered(source: list[str], response: list[str]) -> tuple[int, int]:
    """(source words, response words) after the last pair of aligned words: the longest increasing run of words that both have once."""
    at: dict[str, int] = {}
    for i, w in enumerate(source):
        at[w] = -1 if w in at else i
    n: dict[str, int] = {}
    for w in response:
        n[w] = n.get(w, 0) + 1
    tails: list[int] = []
    where: list[int] = []
    for j, w in enumerate(response):
        i = at.get(w, -1)
        if i >= 0 and n[w] == 1:
            k = bisect_left(tails, i)
            if k == len(tails):
                tails.append(i)
                where.append(j)
            else:
                tails[k], where[k] = i, j
    if not tails:
        return len(source), len(response)
    # the word before the last must support it; a lone far anchor at the end doesn't count as reached
    last, j = tails[-1], where[-1]
    if len(tails) > 2 and last - tails[-2] > 25 and len(response) - j < 4:
        last = tails[-2]
    return len(source) - 1 - last, len(response) - 1 - j


def is_truncated(source: str, response: str, slack: int = 12) -> bool:
    """slack: words of the source that may follow the last aligned word beyond those that follow it in the response."""
    a, b = _WORD.findall(source.casefold()), _WORD.findall(response.casefold())
    if len(a) < 5:  # too little to align with
        return len(b) >= 5 and not _FINAL.search(response) and unclosed(source, response)
    rest, tail = uncovered(a, b)
    if rest - tail > slack or (rest - tail > 2 and unclosed(source, response)):
        return True
    source, response = source.rstrip(), response.rstrip()
    ends, open_source = bool(_FINAL.search(source)), bool(_OPEN.search(source))
    if not ends and not open_source and rest - tail <= 2:
        return False  # the source itself stops without a mark, and the response reaches that place
    if open_source:
        return rest - tail > 4 and (not _FINAL.search(response) or bool(_OPEN.search(response)))
    if ends and (not _FINAL.search(response) or _OPEN.search(response)):
        return True
    return not ends and rest - tail > 4 and not _FINAL.search(response)


#: A sentence is foreign with so many of its letters in foreign words; a response with so many of its letters in foreign sentences.
FOREIGN_WORDS, FOREIGN_SENTENCES = 0.4, 1 / 3


def _sides(source: str | None, response: str | None) -> tuple[set[str], set[str], bool]:
    """(words of the source, words the response has beyond them, whether the response follows its source)."""
    a, b = set(_WORD.findall((source or "").lower())), set(_WORD.findall((response or "").lower()))
    new = b - a
    return a, new, bool(b) and len(b) - len(new) >= 0.45 * len(b)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, home, away): in how many sources and following responses a word stands, and in how many others; summed up within a task."""
    home: Counter = Counter()
    away: Counter = Counter()

    def flush() -> pa.RecordBatch:
        ws = list(home.keys() | away.keys())
        b = pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([home[w] for w in ws], pa.int64()), pa.array([away[w] for w in ws], pa.int64())], names=["w", "home", "away"])
        home.clear()
        away.clear()
        return b

    for b in batches:
        for s, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            old, new, follows = _sides(s, r)
            home.update(old)
            (home if follows else away).update(new)
        if len(home) + len(away) > 500_000:
            yield flush()
    yield flush()


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, defects, letters, follows, words): all rules but the one that needs the counts, and, where that one may hold, the words the source hasn't, by sentence.

    Less than FOREIGN_WORDS * FOREIGN_SENTENCES of all letters in such words can't make a response foreign, so those words are left out.
    """
    kind = pa.list_(pa.struct([("i", pa.int32()), ("n", pa.int32()), ("w", pa.string()), ("own", pa.int32())]))
    for b in batches:
        found, letters, follow, words = [], [], [], []
        for s, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if is_empty(r):
                found.append(["empty"])
                letters.append(0)
                follow.append(False)
                words.append([])
                continue
            s = s or ""
            got = []
            if is_refusal(s, r):
                got.append("refusal")
            if s:
                x, y = fold(s), fold(r)
                if x and x in y:
                    got.append("copy")
                elif copied_prefix(x, y):
                    got.append("copied_prefix")
            if is_truncated(s, r):
                got.append("truncated")
            if unclosed(s, r):
                got.append("unclosed")
            parts = sentences(r)
            n = sum(len(w) for p in parts for w in p)
            scripts = new_scripts(s, r)
            odd = sum(len(p.findall(r)) for p in scripts)
            if scripts and odd >= 0.1 * n:
                got.append("script_mismatch")
            _, new, follows = _sides(s, r)
            rows: list[dict] = []
            if sum(len(w) for p in parts for w in p if w in new) >= FOREIGN_WORDS * FOREIGN_SENTENCES * n:
                for i, p in enumerate(parts):
                    size = sum(map(len, p))
                    mine = Counter(w for w in p if w in new)
                    for w, k in mine.items():
                        rows.append({"i": i, "n": size, "w": None if any(x.search(w) for x in scripts) else w, "own": k * len(w)})
            found.append(got)
            letters.append(n)
            follow.append(follows)
            words.append(rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string())), pa.array(letters, pa.int32()), pa.array(follow, pa.bool_()), pa.array(words, kind)], names=["n", "defects", "letters", "follows", "words"])


def flag_pairs(df: DataFrame, key: str, source: str, response: str, out_tokens: str | None = None) -> DataFrame:
    """(key, defects array<string>) of every pair; the array is empty for a sound pair. With out_tokens the logged number of tokens is looked at too."""
    d = df.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(response).alias("r"), (F.col(out_tokens).cast("long") if out_tokens else F.lit(None).cast("long")).alias("t"))
    counts = d.select("s", "r").mapInArrow(_count, "w string, home long, away long").groupBy("w").agg(F.sum("home").alias("home"), F.sum("away").alias("away"))
    own = F.struct("k", "t")
    kind = d.select(own.alias("n")).schema["n"].dataType.simpleString()
    words = "array<struct<i:int,n:int,w:string,own:int>>"
    seen = d.select(own.alias("n"), "s", "r").mapInArrow(_judge, f"n {kind}, defects array<string>, letters int, follows boolean, words {words}")
    seen = cut(seen.withColumn("row", F.monotonically_increasing_id()), "judged")  # written, so that the row numbers stay
    each = seen.where(F.size("words") > 0).select("row", "letters", "follows", F.explode("words").alias("x")).select("row", "letters", "follows", "x.*")
    # without the pair's own share in the counts
    mine = F.col("follows").cast("int")
    home, away = F.coalesce("home", F.lit(0)) - mine, F.coalesce("away", F.lit(0)) - (1 - mine)
    unseen = F.col("w").isNotNull() & (home + away == 0)  # says nothing by itself in a response that follows its source
    strange = each.join(counts, "w", "left").withColumns({"odd": F.when(F.col("w").isNull() | (away > home) | (unseen & ~F.col("follows")), F.col("own")).otherwise(0), "unseen": F.when(unseen & F.col("follows"), F.col("own")).otherwise(0)})
    by = strange.groupBy("row", "letters", "i", "n").agg(F.sum("odd").alias("odd"), F.sum("unseen").alias("unseen")).where((F.col("odd") > 0) & (F.col("odd") + F.col("unseen") >= FOREIGN_WORDS * F.col("n")))
    other = by.groupBy("row", "letters").agg(F.sum("n").alias("n")).where(F.col("n") >= FOREIGN_SENTENCES * F.col("letters") - 1e-9).select("row", F.lit("other_language").alias("other"))
    j = seen.select("row", "n", "defects", "letters").join(other, "row", "left")
    got = F.concat("defects", F.array_compact(F.array("other")))
    if out_tokens:
        rate = F.col("n.t") / F.col("letters")
        usual = seen.where("n.t > 0 and letters > 0").agg(F.median(F.round(rate, 3)).alias("usual"))  # counts of rounded rates: few values
        j = j.join(F.broadcast(usual))
        got = F.concat(got, F.array_compact(F.array(F.when((F.col("n.t") >= 0) & (F.col("letters") > 0) & ((rate < F.col("usual") / 2) | (rate > F.col("usual") * 2)), "token_misfit"))))
    return j.select(F.col("n.k").alias(key), got.alias("defects"))


def first_defect(defects: Column) -> Column:
    """The one defect that counts where several apply; null for none."""
    return F.try_element_at(F.filter(F.array(*[F.lit(x) for x in ORDER]), lambda x: F.array_contains(defects, x)), F.lit(1))
