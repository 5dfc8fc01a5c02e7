"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(text: Column, least: int = 2) -> Column:
    """Lower-cased runs of letters of at least ``least``, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}{%d,}" % least), F.lit(0))


def cjk_bigrams(text: Column) -> Column:
    """Pairs of neighbouring CJK characters: what stands in for a dictionary segmenter."""
    chars = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^一-鿿]+", " "), "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - 1, F.lit(1))), lambda i: F.concat(F.get(chars, i - 1), F.get(chars, i)))
    return F.filter(pairs, lambda p: p.rlike("^[一-鿿]{2}$"))


def without_stop_words(tokens: Column, stop: tuple[str, ...], least: int = 2) -> Column:
    """Keeps repeats, unlike array_except."""
    return F.filter(tokens, lambda t: ~t.isin(*stop) & (F.length(t) >= least))


def chunks(text: Column, size: int = 1500, step: int = 1200) -> Column:
    """Overlapping pieces of ``size`` characters, one every ``step``; the short tail stays; none for an empty text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size))))


def sentences(text: Column, least: int = 1) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) >= least)


def occurrences(text: Column, term: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def language(text: Column) -> Column:
    """zh, en, mixed or unknown by the shares of CJK and Latin characters."""
    total = F.greatest(F.length(text), F.lit(1))
    share = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]", "")) / total
    zh, en = share("一-鿿"), share("a-zA-Z")
    return F.when((zh > 0.3) & (en > 0.3), "mixed").when(zh > 0.3, "zh").when(en > 0.3, "en").otherwise("unknown")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0))


def choice_answer(text: Column) -> Column:
    """The option letter of a model's answer: after 'answer is', in brackets, before a stop; else a leading letter."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"(?i)answer(?: is)?:?\s*\(?([A-D])\b", r"\(([A-D])\)", r"\b([A-D])[.)]", r"^\s*([A-D])")]
    return F.upper(F.coalesce(*found))


def stated_confidence(text: Column, none: float = 0.5) -> Column:
    """The confidence that an answer states, in Chinese or English or as a percentage before the word; values above 1 are
    percentages. ``none`` where no number is stated, or none that is one."""
    patterns = (r"(?i)置信度[:：\s]*([0-9.]+)", r"(?i)confidence[:\s]*([0-9.]+)", r"(?i)([0-9.]+)\s*%\s*(?:置信|confidence)")
    value = F.coalesce(*[F.regexp_extract(text, p, 1).try_cast("double") for p in patterns])
    return F.coalesce(F.when(value > 1, value / 100).otherwise(value), F.lit(none))


def json_block(text: Column) -> Column:
    """The fenced json block, else the first braces to the last."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))


def question_pairs(text: Column) -> Column:
    """Q1:/A1: lines of a model's answer as (question, answer)."""
    q = F.regexp_extract_all(text, F.lit(r"(?m)^Q\d*:\s*(.+)$"), F.lit(1))
    a = F.regexp_extract_all(text, F.lit(r"(?m)^A\d*:\s*(.+)$"), F.lit(1))
    return F.filter(F.arrays_zip(q.alias("question"), a.alias("answer")), lambda x: x["question"].isNotNull() & x["answer"].isNotNull())


def coordinates(text: Column) -> Column:
    """(ra, dec) of the first pair of decimal numbers in a text; null if there is none or dec is beyond a pole."""
    number = r"([+-]?\d+\.\d+)"
    pattern = r"(?i)(?:ra\s*=?\s*)?" + number + r"\s*[,\s]\s*(?:dec\s*=?\s*)?" + number
    ra, dec = (F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("double") for k in (1, 2))
    return F.when(ra.isNotNull() & (F.abs(dec) <= 90), F.struct(ra.alias("ra"), dec.alias("dec")))


# Stop words of the tokenisers.
STOP_A = tuple("""the a an is are was were be been have has had do does did will would could should may might must shall can
need dare ought used to of in for on with at by from as into through during before after above below between and but or yet so
if because although though while where when that which who whom whose what this these those i me my mine myself you your yours
yourself he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves""".split())
STOP_B = tuple("""的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 这些 那些 这个 那个 之 与 及 等
the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought
used to of in for on with at by from as into through during before after above below between under and but or yet so""".split())
STOP_D = tuple("the a an is are was were and or but in on at to for of with by 这个 那个 什么 怎么 为什么 请 的 了 在".split())
STOP_LITERATURE = tuple("""the and for are but not you all can had her was one our out day get has him his how its may new now
old see two way who boy did she use""".split())


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def specialist_tokens(text: Column) -> Column:
    """Tokeniser A: lower case; letters, digits, underscores, hyphens and stops stay; no stop words or single characters."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s\-.]", " ")
    return without_stop_words(_split(kept), STOP_A)


def bilingual_tokens(text: Column) -> Column:
    """Tokeniser B: CJK bigrams, then Latin words in lower case, without stop words and single characters."""
    latin = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return without_stop_words(F.concat(cjk_bigrams(text), latin), STOP_B)


def mixed_words(text: Column) -> Column:
    """Tokeniser C: lower-cased words of Latin letters and CJK characters only, two or longer; a word with a digit, an
    underscore or another script's letter in it is none. Repeats stay."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda w: w.rlike("^[a-z一-鿿]{2,}$"))


def keywords(text: Column, stop: tuple[str, ...] = STOP_D, least: int = 2) -> Column:
    """Tokeniser D: words of letters, digits and underscores; with STOP_LITERATURE and ``least`` 4 the literature's form."""
    return without_stop_words(_split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_\s]", " ")), stop, least)


def spaced_words(text: Column, least: int = 3) -> Column:
    """Tokeniser E: full-width punctuation parts words, as space does; each word once."""
    words = _split(F.translate(F.coalesce(text, F.lit("")), "，。？", "   "))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= least))


def topic_sentences(text: Column, terms: tuple[str, ...], most: int = 3) -> Column:
    """The first ``most`` sentences that hold one of the terms, in either case."""
    low = lambda s: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(s), t))
    return F.slice(F.filter(sentences(text), low), 1, most)


def reasoning_steps(text: Column, longer: int = 20, most: int = 5) -> Column:
    """Parts between full stops and line ends of more than ``longer`` characters."""
    return F.slice(F.filter(F.transform(F.split(text, "[。.\n]"), F.trim), lambda s: F.length(s) > longer), 1, most)


def reference_sentences(text: Column, longer: int = 5) -> Column:
    return F.filter(F.transform(F.split(text, "。"), F.trim), lambda s: F.length(s) > longer)


# Words that lower an answer's confidence, and the soft topics.
UNSURE = ("可能", "也许", "不确定", "推测", "might", "possibly", "uncertain")
SOFT_TOPICS = ("cataclysmic_variable", "white_dwarf", "binary", "pulsating")


def response_confidence(answer: Column) -> Column:
    """0.7, and 0.1 for more than 500 characters, -0.05 for each unsure word, 0.05 for a reference; 0.5 to 0.95."""
    low = F.lower(answer)
    value = F.lit(0.7) + F.when(F.length(answer) > 500, 0.1).otherwise(0.0)
    for word in UNSURE:
        value = value - F.when(F.contains(low, F.lit(word)), 0.05).otherwise(0.0)
    value = value + F.when(F.contains(answer, F.lit("[")) | F.contains(low, F.lit("ref")), 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.5), F.least(F.lit(0.95), value))


def soft_labels(answer: Column, topics: tuple[str, ...] = SOFT_TOPICS) -> Column:
    """Map of topic to its share: the share of the topic's words that stand in the text and 0.1, 1 at most, over the sum."""
    low = F.lower(answer)
    raw = [F.least(F.lit(1.0), sum((F.contains(low, F.lit(w)).cast("double") for w in t.split("_")), F.lit(0.0)) / len(t.split("_")) + 0.1) for t in topics]
    return F.map_from_arrays(F.array(*map(F.lit, topics)), F.transform(F.array(*raw), lambda x: x / sum(raw[1:], raw[0])))


def learned_key(query: Column, words: int = 3) -> Column:
    """What a query's learned labels are kept under: its first words, in lower case."""
    return F.array_join(F.slice(_split(F.lower(query)), 1, words), " ")


# Words of a query that raise a soft topic, in the order in which they are looked for.
PRIOR_WORDS = (("cataclysmic_variable", ("cataclysmic", "cv")), ("white_dwarf", ("white dwarf",)), ("binary", ("binary",)))


def query_prior(query: Column, topics: tuple[str, ...] = SOFT_TOPICS, raised: float = 0.6) -> Column:
    """Map of topic to weight before an answer is seen: equal shares, of which the topic that the query names first in
    ``PRIOR_WORDS`` is raised; the others keep theirs."""
    low = F.lower(F.coalesce(query, F.lit("")))
    named = F.lit(None).cast("string")
    for topic, words in reversed(PRIOR_WORDS):
        holds = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        named = F.when(holds, topic).otherwise(named)
    return F.map_from_arrays(F.array(*map(F.lit, topics)), F.array(*[F.when(named == t, raised).otherwise(1 / len(topics)) for t in topics]))


# Forms of object names: catalogue and number, variable star, transient; then star and constellation.
NAME_FORMS = (r"[A-Z]{2,}\s+\d+", r"V\d+\s+[A-Za-z]+", r"[ATFGPS]\s*\d{4}[\-+]\d{2,4}", r"[A-Z]{1,2}\s+[A-Za-z]{1,3}")


def object_names(text: Column, most: int = 10, forms: tuple[str, ...] = NAME_FORMS) -> Column:
    """The first ``most`` distinct object names of a text, in order of code points. A name begins and ends at a word's
    edge; space within it becomes one blank, so that a name broken over lines is the same name."""
    whole = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?<![\p{{L}}\p{{N}}_]){form}(?![\p{{L}}\p{{N}}_])"), F.lit(0)) for form in forms]
    return F.slice(F.array_sort(F.array_distinct(F.transform(F.concat(*whole), lambda n: F.regexp_replace(n, r"\s+", " ")))), 1, most)


def query_complexity(text: Column, words: tuple[str, ...] = ("分析", "比较", "为什么", "原因", "机制", "详细", "推导", "计算", "模型", "理论")) -> Column:
    return F.when(text.rlike("|".join(words)) | (F.length(text) > 100), "complex").otherwise("simple")


def query_route(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("variable|cv|nova"), "variable_star").when(low.rlike("spectrum|spectral"), "spectral_classification").otherwise("general_analysis")


def relevant_header(columns: Column, words: tuple[str, ...] = ("ra", "dec", "period", "magnitude", "source", "name")) -> Column:
    """Whether a table's column names look like a catalogue's."""
    return F.exists(columns, lambda c: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(c), w)))


def name_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def safe_file_name(name: Column) -> Column:
    return F.translate(F.translate(name, " ", "_"), "/", "_")


def sexagesimal(text: Column) -> Column:
    """(ra, dec) in degrees of the first ``hh:mm:ss.s +dd:mm:ss`` (or with h m s and d m s) in a text, else null."""
    part = r"(\d{1,2})\s*[:hd°\s]\s*(\d{1,2})\s*[:m'\s]\s*(\d{1,2}(?:\.\d+)?)\s*[s\"]?"
    pattern = part + r"\s*,?\s*([+-])\s*" + part
    g = [F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in range(1, 8)]
    degrees = lambda d, m, s: d.try_cast("double") + m.try_cast("double") / 60 + s.try_cast("double") / 3600
    ra, dec = degrees(*g[0:3]) * 15, degrees(*g[4:7]) * F.when(g[3] == "-", -1).otherwise(1)
    return F.when(ra.isNotNull() & (ra < 360) & (F.abs(dec) <= 90), F.struct(ra.alias("ra"), dec.alias("dec")))
