"""Keyword-stuffed pages, link lists and product tags.

Of each message the sender's own words are taken (see bodies). Every word, link, hashtag and number of the whole body is a token; links,
tags and numbers are one token each by class, so that a list of links is a page that repeats one token; a whole sentence said again
counts once. Two measures describe a page:
- its rank-frequency curve: SQL windows over the frequency spectrum rank the tokens and fit log frequency on log rank (slope, residual);
- its divergence from prose: the sum over its tokens of p ln(p / q), q the token's share in prose of the language that gives the least sum.

Pages made of sentences give, by language and length, the range of slope, residual and divergence (median, and the distance to the
quantiles at 0.159 and 0.841, which stray pages hardly move). Keywords written as sentences can be most of a language's few pages of one
length, so pages that the range of the whole language flags are left out of the ranges by length, however many they are. A page is a
candidate if its divergence leaves that range and its joint distance in the three measures is extreme. An exact check then says what a
candidate repeats: content words (keywords), links or hashtags; pages that are mostly numbers or settings (tables, alerts), or whose words
don't repeat (agendas, notices), are none of these.

Defined cases: null, empty and blank texts aren't flagged; texts of any length are read whole; repeated rows are judged each; empty
tables give an empty result; further columns are ignored; where a language and length have too few pages of prose, the language's range
counts, then the length's, then that of all pages; where there is no prose at all, nothing is flagged. Pages without any function word of
a listed language are never prose, so that keywords between full stops don't set the range.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bodies import own_body
from tidemark.session import cut

#: Common function words of the languages told apart by them; others are told by script.
FUNCTION_WORDS = {
    "en": "a about after all an and any are as at be because been before but by can could do every for from had has have he her his how i if in into is it its me more my no not of on once one only or our out over should so some still than that the their them then there they this to too up us was we were what when which who will with would you your".split(),
    "de": "aber als am an auch auf aus bei bevor bis bitte bin das dass dem den der des die ein eine einem einen einer es für haben hat hatte ich im in ist ja kann können mein meine mit morgen nach nicht nichts noch nur oder sehr sich sie sind über um und uns vom von vor war weil wenn wer wir wird wurde zu zum zur".split(),
    "fr": "a ai au aux avant avec avez avons bien ce ces cette dans de des deux du elle en est et être fait il ils j je la le les leur ma mais me même mon n ne nous on ou par pas plus pour qu que qui sa sans se ses son sont sur tout très un une vous y été".split(),
    "es": "a al antes como con cuando de del el ella en es esta este estoy están fue ha han hasta hay la las le lo los me mi muy más nada no nos o para pero por porque que se si sin sobre su sus también todo un una y ya".split(),
    "ru": "а бы был была было в вас вы для до его если ещё же за и из к как ко ли мне мы на не но о об он она они от по при с со так то у что чтобы это я".split(),
}
_OF_WORD: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _OF_WORD[_w] = (*_OF_WORD.get(_w, ()), _lang)

URL = re.compile(r"(?:h(?:tt|xx)ps?://|www\.)[^\s<>\"')\]]+", re.I)
LINK, TAG, NUMBER = "\x00link", "\x00tag", "\x00number"
_TOKEN = re.compile(r"#?[^\W_]+(?:['’][^\W_]+)*")
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?。！？…]['\"”’)\]]*\s*$")
_SPLIT = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]+")
_CJK_GAP = re.compile(r"[぀-ヿ㐀-鿿가-힯]\s+[぀-ヿ㐀-鿿가-힯]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+")
_KANA = re.compile(r"[぀-ヿ]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_CAMEL = re.compile(r"[A-ZА-ЯЁÀ-ÞЀ-Џ]?[a-zà-ÿа-яё]+|[A-ZА-ЯЁÀ-Þ]+|\d+|[぀-ヿ㐀-鿿가-힯]+")
_SETTING = re.compile(r"(?<=\w)=(?=\S)")
_LEET = str.maketrans("013457@$", "oieast" "as")
_BULLET = re.compile(r"^\s*(?:[-*•·]|\d{1,3}[.)])\s*")


def sentence_words(s: str) -> int:
    """Words of a sentence; a character of scripts without spaces counts a half."""
    cjk = sum(map(len, _CJK.findall(s)))
    return len(_WORD.findall(_CJK.sub(" ", s))) + cjk // 2


def words_in_sentences(body: str) -> tuple[int, int]:
    """Words in pieces that end as sentences do and aren't lists, and in all others."""
    words = loose = 0
    for line in URL.sub(" ", body).split("\n"):
        s = _BULLET.sub("", line).strip()
        for piece in _SPLIT.split(s) if s else ():
            n = sentence_words(piece)
            if _END.search(piece) and n >= 3 and piece.count(",") <= max(3, n // 4) and not piece.startswith("#"):
                words += n
            else:
                loose += n
    return words, loose


def _sentence_key(piece: str) -> tuple[str, ...] | None:
    """What makes two sentences the same (numbers and names apart), or None where a piece doesn't read as one: it ends as sentences do
    and has function words, or is a run of a script without spaces, or is in a script without listed function words."""
    if not _END.search(piece) or piece.startswith("#"):
        return None
    cjk = "".join(_CJK.findall(piece))
    if cjk:
        return (cjk,) if len(cjk) >= 8 and not _CJK_GAP.search(piece) else None
    words = _WORD.findall(piece)
    plain = tuple(w for w in words if not (w[0].isupper() and _LATIN.match(w)))
    if len(words) < 4 or len(plain) < 2:
        return None
    listed = sum(w.lower() in _OF_WORD for w in words)
    foreign = not _LATIN.match(plain[0]) and not _CYRILLIC.match(plain[0])
    return plain if foreign or (len(words) >= 5 and listed >= 0.15 * len(words)) else None


def said_once(body: str) -> str:
    """The body without repetitions of whole sentences."""
    seen: set[tuple[str, ...]] = set()
    out = []
    for line in body.split("\n"):
        kept = []
        for piece in _SPLIT.split(line):
            k = _sentence_key(_BULLET.sub("", piece).strip())
            if k is None or k not in seen:
                kept.append(piece)
            if k is not None:
                seen.add(k)
        out.append(" ".join(kept))
    return "\n".join(out)


def normal(token: str) -> str:
    """A word with trailing numbers dropped and look-alike digits undone."""
    t = token.lower().lstrip("#")
    if t.isalpha():
        return t
    t = re.sub(r"(?<=\D)\d+$", "", t)
    return t.translate(_LEET) if re.search(r"[a-z]\d|\d[a-z]", t) else t


def page_tokens(body: str) -> Counter[str]:
    """How often each token occurs; runs of scripts without spaces give their pairs of characters; single letters that aren't words of a
    language are none."""
    counts: Counter[str] = Counter()
    text = URL.sub(" ", body)
    counts[LINK] = len(URL.findall(body))
    for tok, k in Counter(_TOKEN.findall(text)).items():
        if tok.isdigit():
            counts[NUMBER] += k
            continue
        if tok[0] == "#":
            counts[TAG] += k
        for w in _CAMEL.findall(tok) if tok[0] == "#" else (tok,):
            if _CJK.search(w):
                for run in _CJK.findall(w):
                    for pair in (run[i : i + 2] for i in range(max(len(run) - 1, 1))):
                        counts[pair] += k
                for other in _WORD.findall(_CJK.sub(" ", w)):
                    counts[normal(other)] += k
            elif len(w) > 1 or w.lower() in _OF_WORD:
                counts[normal(w)] += k
    return +counts


def language(body: str, counts: Counter[str]) -> str:
    """Language by script, or by the function words that occur; `other` for scripts without listed words, `none` for text without any."""
    text = URL.sub(" ", body)
    letters = sum(map(len, _WORD.findall(text)))
    cjk = sum(map(len, _CJK.findall(text)))
    if cjk * 3 > letters:
        return "ja" if _KANA.search(text) else "zh"
    if len(_CYRILLIC.findall(text)) * 2 > letters:
        return "ru"
    if sum(map(len, _LATIN.findall(text))) * 2 < letters:
        return "other"
    langs: Counter[str] = Counter()
    for w, k in counts.items():
        for lang in _OF_WORD.get(w, ()):
            langs[lang] += k
    return max(langs, key=lambda x: (langs[x], x)) if langs else "none"


def page_facts(text: str | None) -> dict:
    body = own_body(text)
    counts = page_tokens(said_once(body))
    words, loose = words_in_sentences(body)
    content = {w: k for w, k in counts.items() if w[0] != "\x00"}
    function = sum(k for w, k in content.items() if w in _OF_WORD)
    others = [w for w in content if w not in _OF_WORD]
    spectrum = Counter(counts.values())
    freq = sorted(spectrum, reverse=True)
    return {
        "lang": language(body, counts), "words": words, "loose": loose, "tokens": sum(counts.values()), "links": counts[LINK], "tags": counts[TAG], "numbers": counts[NUMBER],
        "function": function, "content": sum(content.values()) - function, "content_types": len(others), "settings": len(_SETTING.findall(URL.sub(" ", body))),
        "freq": freq, "types_of": [spectrum[f] for f in freq], "token": list(counts), "times": list(counts.values()),
    }


_COUNTS = ("words", "loose", "tokens", "links", "tags", "numbers", "function", "content", "content_types", "settings")
_LISTS = {"freq": pa.int32(), "types_of": pa.int32(), "token": pa.string(), "times": pa.int32()}
_SCHEMA = "lang string, " + ", ".join(f"{c} int" for c in _COUNTS) + ", freq array<int>, types_of array<int>, token array<string>, times array<int>"


def facts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of facts per document, made where it is read; texts don't travel further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [page_facts(t.as_py()) for t in b.column(1)]
            cols = [pa.array([r["lang"] for r in rows], pa.string()), *[pa.array([r[c] for r in rows], pa.int32()) for c in _COUNTS]]
            lists = [pa.array([r[c] for r in rows], pa.list_(t)) for c, t in _LISTS.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *lists], names=["key", "lang", *_COUNTS, *_LISTS])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {_SCHEMA}")


def curves(pages: DataFrame) -> DataFrame:
    """Slope and residual of log frequency on log rank for each row of facts. Words of one frequency share the middle of their ranks and
    count as often as they are; a page has few different frequencies, so what is ranked is small."""
    s = pages.select("row", F.explode(F.arrays_zip("freq", "types_of")).alias("z")).select("row", F.col("z.freq").alias("f"), F.col("z.types_of").alias("w"))
    upto = Window.partitionBy("row").orderBy(F.col("f").desc())
    s = s.withColumn("x", F.log(F.sum("w").over(upto) - (F.col("w") - 1) / 2)).withColumn("y", F.log("f"))
    m = {n: F.sum(e) for n, e in {"n": F.col("w"), "sx": F.col("w") * F.col("x"), "sy": F.col("w") * F.col("y"), "sxx": F.col("w") * F.col("x") * F.col("x"), "sxy": F.col("w") * F.col("x") * F.col("y"), "syy": F.col("w") * F.col("y") * F.col("y")}.items()}
    g = s.groupBy("row").agg(*[e.alias(n) for n, e in m.items()])
    vx, vy, c = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    slope = c / F.when(vx > 1e-9, vx)
    return g.select("row", slope.alias("slope"), F.sqrt(F.greatest(vy - slope * c, F.lit(0.0)) / F.col("n")).alias("residual"))


#: The languages prose can be in: those `language` names but `none`.
LANGUAGES = (*FUNCTION_WORDS, "ja", "zh", "other")
#: Those whose prose shows by its function words.
_LISTED = tuple(FUNCTION_WORDS)


def divergences(pages: DataFrame, prose: DataFrame, rarest: float, least_pages: int) -> DataFrame:
    """For each row the least divergence of its tokens from those of prose of a language, and that language.

    q is the share of a token among all (page, token) of the language's prose, at least `rarest`: so a language lists at most 1 / rarest
    tokens, which bounds what is broadcast. A language with fewer than `least_pages` pages of prose is none to be near to."""
    seen = prose.select("lang", F.explode("token").alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("df"))
    total = F.sum("df").over(Window.partitionBy("lang"))
    q = cut(seen.withColumn("q", F.col("df") / total).where(F.col("q") >= rarest).select("lang", "token", "q"))
    by_token = q.groupBy("token").agg(*[F.max(F.when(F.col("lang") == x, F.col("q"))).alias(f"q_{x}") for x in LANGUAGES])
    known = prose.agg(*[(F.count_if(F.col("lang") == x) >= least_pages).alias(f"has_{x}") for x in LANGUAGES])
    each = pages.select("row", "tokens", F.explode(F.arrays_zip("token", "times")).alias("z")).select("row", F.col("z.token").alias("token"), (F.col("z.times") / F.col("tokens")).alias("p"))
    each = each.join(F.broadcast(by_token), "token", "left")
    d = each.groupBy("row").agg(*[F.sum(F.col("p") * F.log(F.col("p") / F.coalesce(f"q_{x}", F.lit(rarest)))).alias(f"d_{x}") for x in LANGUAGES])
    d = d.join(F.broadcast(known), F.lit(True))
    nearest = F.least(*[F.when(F.col(f"has_{x}"), F.struct(F.col(f"d_{x}").alias("d"), F.lit(x).alias("x"))) for x in LANGUAGES])
    return d.select("row", nearest.alias("nearest")).select("row", F.col("nearest.d").alias("divergence"), F.col("nearest.x").alias("near"))


#: The measures in which a page is held against prose, and the least spread each is given.
MEASURES = {"slope": 0.05, "residual": 0.02, "divergence": 0.1}
_RANGE = [f"{m}_{q}" for m in MEASURES for q in ("mid", "low", "high")]


def prose_ranges(prose: DataFrame, least_pages: int, by: list[str]) -> DataFrame:
    """For each value of `by` with enough pages, and for those of each part of `by` (`level` is the grouping id), median and spread of each
    measure. The measures are rounded to hundredths first, so that exact quantiles need a bounded number of counters each."""

    def quantile(m: str, at: float):
        return F.percentile(F.round(m, 2), F.lit(at))

    aggs = [F.grouping_id().alias("level"), F.count(F.lit(1)).alias("pages")]
    for m, least in MEASURES.items():
        mid, low, high = (quantile(m, a) for a in (0.5, 0.159, 0.841))
        aggs += [mid.alias(f"{m}_mid"), F.greatest(mid - low, F.lit(least)).alias(f"{m}_low"), F.greatest(high - mid, F.lit(least)).alias(f"{m}_high")]
    return cut(prose.cube(*by).agg(*aggs).where(F.col("pages") >= least_pages))


def page_scores(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, least_words: int = 25, least_links: int = 5, least_tags: int = 10, least_pages: int = 30, rarest: float = 2e-4, far: float = 2.5, joint: float = 3.0
) -> DataFrame:
    """One row per document: the key, its counts, its curve and divergence, their distances from prose (`slope_z`, `residual_z`,
    `divergence_z`, `distance`), `extreme`, what it repeats (`keywords`, `link_list`, `tag_list`) and `flagged`."""
    pages = cut(facts(df, key, text).withColumn("row", F.monotonically_increasing_id()).withColumn("size_class", F.floor(F.log2(F.greatest("tokens", F.lit(1)))).cast("int")))
    function_share = F.col("function") / F.greatest(F.col("function") + F.col("content"), F.lit(1))
    is_prose = (F.col("words") >= least_words) & (F.col("loose") < 0.2 * (F.col("words") + F.col("loose"))) & F.col("lang").isin(*LANGUAGES) & (~F.col("lang").isin(*_LISTED) | (function_share >= 0.1))
    p = pages.drop("freq", "types_of", "token", "times").join(curves(pages), "row", "left").join(divergences(pages, pages.where(is_prose), rarest, least_pages), "row", "left")
    p = cut(p.withColumn("prose", is_prose).fillna(0.0, ["slope", "residual", "divergence"]).withColumn("lang", F.coalesce("near", "lang")).drop("near"))

    def judged(q: DataFrame, prose: DataFrame, by: list[str]) -> DataFrame:
        """The pages `q` with their distances from the most particular range of `prose` with enough pages, and what they repeat."""
        ref = prose_ranges(prose, least_pages, by)
        levels = range(2 ** len(by))
        for level in levels:  # a few rows for each language
            on = [c for c, bit in zip(by, f"{level:0{len(by)}b}", strict=True) if bit == "0"]
            r = ref.where(F.col("level") == level).select(*on, F.struct(*_RANGE).alias(f"r{level}"))
            q = q.join(F.broadcast(r), on, "left") if on else q.join(F.broadcast(r), F.lit(True), "left")
        q = q.withColumn("ref", F.coalesce(*[f"r{level}" for level in levels]))

        def away(m: str):
            d = F.col(m) - F.col(f"ref.{m}_mid")
            return F.coalesce(d / F.when(d < 0, F.col(f"ref.{m}_low")).otherwise(F.col(f"ref.{m}_high")), F.lit(0.0))

        # steeper, more uneven, farther: each counts on its extreme side only
        q = q.withColumn("slope_z", -away("slope")).withColumn("residual_z", away("residual")).withColumn("divergence_z", away("divergence"))
        distance = F.sqrt(sum(F.pow(F.greatest(F.col(z), F.lit(0.0)), F.lit(2.0)) for z in ("slope_z", "residual_z", "divergence_z")))
        q = q.withColumn("distance", distance).withColumn("extreme", (F.col("divergence_z") > far) & (F.col("distance") > joint))
        tokens = F.greatest("tokens", F.lit(1))
        repetition = F.col("content") / F.greatest("content_types", F.lit(1))
        listed = (F.col("numbers") >= 0.5 * tokens) | ((F.col("numbers") >= 0.41 * tokens) & (repetition < 1.7)) | (F.col("settings") >= 0.1 * tokens)
        keywords = F.col("extreme") & ~listed & (F.col("tokens") >= least_words) & (repetition >= 1.5) & (function_share < 0.3)
        links = F.col("extreme") & ~listed & (F.col("links") >= least_links) & (F.col("links") >= 0.12 * tokens) & (F.col("words") < 3.5 * F.col("links"))
        tags = F.col("extreme") & ~listed & (F.col("tags") >= least_tags) & (F.col("tags") >= 0.1 * tokens)
        q = q.withColumns({"repetition": repetition, "function_share": function_share, "keywords": keywords, "link_list": links, "tag_list": tags})
        return q.withColumn("flagged", F.col("keywords") | F.col("link_list") | F.col("tag_list"))

    # stuffed pages written as sentences can be most of a language's few long pages: what its whole range flags sets none by length
    prose = judged(p.where("prose"), p.where("prose"), ["lang"]).where(~F.col("flagged"))
    return judged(p, prose, ["lang", "size_class"]).select(
        F.col("key").alias(key), "lang", "words", "loose", "tokens", "links", "tags", "numbers", "repetition", "function_share", "slope", "residual", "divergence",
        "slope_z", "residual_z", "divergence_z", "distance", "extreme", "keywords", "link_list", "tag_list", "flagged",
    )
