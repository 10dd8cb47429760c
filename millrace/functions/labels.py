"""Rule labels with abstention, format checks and surface diagnostics of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: What opens a question, and what marks each intent.
OPENERS = ("jak ", "jaki ", "jaka ", "jakie ", "kto ", "co ", "czym ", "gdzie ", "kiedy ", "dlaczego ", "ile ", "czy ", "który ", "która ", "które ")
DEFINITION, PROCEDURE = ("co to ", "czym jest ", "co oznacza ", "definicja "), ("jak ", "w jaki sposób ", "instrukcja ")
COMPARISON, ENTITY = ("różnica między", "porównanie", "czym różni"), ("kto ", "gdzie ", "nazwa ", "adres ")
#: What shows that a passage can answer an intent.
APPLICABLE = {"comparison": ("natomiast", "w porównaniu", "różni"), "procedure": ("należy", "krok", "najpierw", "następnie"), "definition": (" oznacza ", " to ", "jest to")}
#: Format patterns.
PREFIX = r"^(?:zapytanie|pytanie|odpowiedź|query|oto|wygenerowane)[ \t\n\r\f]*[:\-]"
LIST_MARK = r"(?:^|\n)[ \t\n\r\f]*(?:[-*]|\d+[.)])[ \t\n\r\f]+"
META = r"(?:^|[^\p{L}\p{N}_])(?:na podstawie pasażu|jako model|nie mogę|wygenerowałem)(?:$|[^\p{L}\p{N}_])"
#: Traces of translation, with their weights.
ENGLISH = ("did", "does", "how", "the", "were", "what", "when", "where", "which", "who", "why")
CALQUE = r"(?:^|[^\p{L}\p{N}_])(?:co jest (?:nazwą|imię|powodem|celem)|jakie jest znaczenie dla|w odniesieniu do czego)(?:$|[^\p{L}\p{N}_])"
SPACING = r"[ \t\n\r\f]+[?!,.:;]|\?[ \t\n\r\f]*\?|![ \t\n\r\f]*!"
PLAIN_TOKEN = r"\p{L}+(?:'\p{L}+)?"
WEIGHTS = {"english_residue": 0.55, "calque_pattern": 0.35, "suspicious_punctuation_spacing": 0.20, "ascii_only_long_query": 0.10}


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def starts(text: Column, what: tuple[str, ...]) -> Column:
    return _any([text.startswith(w) for w in what])


def holds(text: Column, what: tuple[str, ...]) -> Column:
    return _any([text.contains(w) for w in what])


#: How sure each form is; marks and confidence of each intent, the first that shows counts; marks of the older styles.
FORM_CONFIDENCE = {"full_question": 0.95, "keyword_query": 0.9, "unknown": 0.45}
INTENTS = (("definition", "starts", DEFINITION, 0.98), ("procedure", "starts", PROCEDURE, 0.94), ("comparison", "holds", COMPARISON, 0.97), ("entity_lookup", "starts", ENTITY, 0.9))
FACT_LOOKUP, KEYWORDS = 0.7, 6
STYLES = (("how_to", "starts", ("jak ", "w jaki sposób")), ("definition", "starts", ("co to", "czym jest", "co oznacza")), ("comparison", "holds", (" czy ", " a ", "różnica", "porówn")))
OLD_KEYWORDS = 5


def _first(tests: list[tuple[Column, object]], otherwise) -> Column:
    """The value of the first test that holds."""
    return F.coalesce(*(F.when(t, F.lit(v)) for t, v in tests), F.lit(otherwise))


def _shows(text: Column, how: str, marks: tuple[str, ...]) -> Column:
    return {"starts": starts, "holds": holds}[how](text, marks)


def query_labels(query: Column) -> dict[str, Column]:
    """form, form_confidence, intent, intent_confidence; unknown where no rule is sure."""
    text = T.normal_form(query)
    return labels_of(text, F.size(T.words(text)))


def labels_of(text: Column, n: Column) -> dict[str, Column]:
    """As query_labels, of a query's normal form and its number of words; each rule looks at them anew, so that they had better be columns."""
    empty, question, short = n == 0, text.endswith("?") | starts(text, OPENERS), n <= KEYWORDS
    form = [(empty, "unknown"), (question, "full_question"), (short, "keyword_query")]
    intent = [(empty, ("unknown", 0.0)), *((_shows(text, how, marks), (name, sure)) for name, how, marks, sure in INTENTS), (question | short, ("fact_lookup", FACT_LOOKUP))]
    return {
        "form": _first(form, "unknown"), "form_confidence": _first([(empty, 0.0), *((t, FORM_CONFIDENCE[v]) for t, v in form[1:])], FORM_CONFIDENCE["unknown"]),
        "intent": _first([(t, v[0]) for t, v in intent], "unknown"), "intent_confidence": _first([(t, v[1]) for t, v in intent], 0.0),
    }


def query_style(query: Column) -> Column:
    """The older combined label."""
    low = F.btrim(F.lower(query))
    by_marks = [(_shows(low, how, marks), name) for name, how, marks in STYLES]
    return _first([*by_marks, (low.endswith("?"), "full_question"), (F.size(T.words(low)) <= OLD_KEYWORDS, "keyword_query")], "fact_lookup")


def intent_applicable(intent: Column, passage: Column) -> Column:
    """True where a passage can answer the intent, null where the rule abstains; never false."""
    text = F.lower(passage)
    out = F.when(intent.isin("fact_lookup", "entity_lookup"), True)
    for name, marks in APPLICABLE.items():
        out = out.when((intent == name) & holds(text, marks), True)
    return out.otherwise(F.lit(None).cast("boolean"))


def format_metrics(query: Column) -> dict[str, Column]:
    text = F.btrim(F.coalesce(query, F.lit("")), F.lit(" \t\n\r\f"))
    low, toks = F.lower(text), T.tokens(text)
    multiple = text.rlike(LIST_MARK) | text.contains("\n")
    prefix, meta = low.rlike(PREFIX), low.rlike(META)
    invalid = T.invalid_characters(text)
    return {
        "empty": text == "", "multiple_query": multiple, "has_prefix": prefix, "has_metacomment": meta, "word_length": F.size(toks).cast("long"), "character_length": F.length(text).cast("long"),
        "language_confidence": T.language_share(toks, T.POLISH_STOPWORDS, T.POLISH_LETTERS, None), "invalid_character_count": invalid.cast("long"),
        "format_valid": (text != "") & ~multiple & ~prefix & ~meta & (invalid == 0),
    }


def translation_flags(query: Column) -> dict[str, Column]:
    """Surface flags and a capped weighted score; a diagnostic, not a proof."""
    toks = F.regexp_extract_all(F.lower(query), F.lit(PLAIN_TOKEN), F.lit(0))
    low = F.lower(T.squeezed(query))
    flags = {
        "english_residue": F.arrays_overlap(toks, F.array(*map(F.lit, ENGLISH))),
        "calque_pattern": low.rlike(CALQUE),
        "suspicious_punctuation_spacing": query.rlike(SPACING),
        "ascii_only_long_query": (F.size(toks) >= 8) & ~F.lower(query).rlike(f"[{T.POLISH_LETTERS}]"),
    }
    score = reduce(lambda a, b: a + b, (F.when(flags[k], F.lit(w)).otherwise(F.lit(0.0)) for k, w in WEIGHTS.items()))
    return flags | {"risk_score": F.least(F.lit(1.0), score)}


def translation_evidence(query: Column) -> dict[str, Column]:
    """What the flags rest on: the sorted English words, and the phrases that look translated word by word."""
    toks = F.regexp_extract_all(F.lower(query), F.lit(PLAIN_TOKEN), F.lit(0))
    words = F.array_sort(F.array_intersect(toks, F.array(*map(F.lit, ENGLISH))))
    phrases = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(T.squeezed(query)), F.lit(CALQUE), F.lit(0)), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")))
    return {"english_words": words, "calques": phrases}


def json_format(text: Column) -> dict[str, Column]:
    """format_metrics of a completion that should be JSON: json_valid, whether it is a list of queries or of non-blank strings, without repairs;
    then it isn't several queries, whatever its lines. An invalid one isn't valid in format."""
    plain, bare = format_metrics(text), F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f"))
    parsed = T.parsed_queries(bare)
    strings = F.from_json(bare, "array<string>", {"mode": "PERMISSIVE"})
    whole = F.coalesce(F.json_array_length(F.concat(F.lit("["), bare, F.lit("]"))) == 1, F.lit(False))  # one value and nothing after it; from_json alone takes what begins well
    listed = F.coalesce(whole & bare.startswith("[") & F.forall(strings, lambda x: F.coalesce((F.btrim(x) != "") & ~x.rlike(r"^[\[{]"), F.lit(False))), F.lit(False))
    valid = (whole & parsed["valid"] & ~parsed["repaired"]) | listed
    out = plain | {"json_valid": valid, "multiple_query": plain["multiple_query"] & ~valid}
    return out | {"format_valid": valid & ~plain["empty"] & ~plain["has_prefix"] & ~plain["has_metacomment"] & (plain["invalid_character_count"] == 0)}


def length_bucket(n: Column, short: int = 64, medium: int = 192) -> Column:
    return F.when(n < short, "short").when(n < medium, "medium").otherwise("long")


def position_bucket(index: Column, count: Column) -> Column:
    """By rounded position; one sentence is the middle."""
    place = F.when(count > 1, F.bround(index * 2 / (count - 1)).cast("int")).otherwise(1)
    return F.element_at(F.array(F.lit("beginning"), F.lit("middle"), F.lit("end")), place + 1)


def overlap_band_reward(value: Column, low: float, high: float) -> Column:
    """1 between low and high; outside, what is left on the line down to 0 at 0 and at 1."""
    if low <= 0 or high >= 1 or low >= high:
        raise ValueError(f"no band inside (0, 1): {low} to {high}")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / low, (1 - value) / (1 - high)))


def third(index: Column, count: Column) -> Column:
    """By the middle of the sentence: which third of the passage it is in."""
    place = (index + 0.5) / count
    return F.when(place <= 1 / 3, "beginning").when(place <= 2 / 3, "middle").otherwise("end")


def lexical_focus(query: Column, passage: Column, least: float = 0.2, cut=T.sentences) -> Column:
    """(sentence, bucket, confidence): the one sentence that holds most of the query's content terms; sentence and bucket are
    null where several do, or none holds the share `least`."""
    terms = F.array_distinct(T.content(T.tokens(query)))

    def of(t: Column) -> Column:
        scores = lambda s: F.transform(s, lambda x: T.share(F.array_intersect(t, T.content(T.tokens(x))), t))
        nothing = (F.size(t) == 0) | (F.size(cut(passage)) == 0)
        best = lambda s: F.array_max(s)
        clear = lambda s: (best(s) >= least) & (F.size(F.filter(s, lambda x: x == best(s))) == 1) & ~nothing
        place = lambda s: (F.array_position(s, best(s)) - 1).cast("int")
        return T.bound(scores(cut(passage)), lambda s: F.struct(
            F.when(clear(s), place(s)).alias("sentence"),
            F.when(clear(s), position_bucket(place(s), F.size(s))).alias("bucket"),
            F.when(nothing, 0.0).otherwise(best(s)).alias("confidence"),
        ))

    return T.bound(terms, of)


def judge_focus(scores: Column, ambiguous: float = 0.1) -> Column:
    """Of an array of sentence scores: (sentence, score, margin to the next best, bucket, ambiguous, sentences); ties go to the
    first, a score that isn't a number is the best and null the last, the margin of a single sentence is infinite, no sentence gives null."""

    def of(s: Column) -> Column:
        by_score = F.array_sort(F.transform(s, lambda x, i: F.struct(x.isNull().alias("none"), (~F.isnan(x)).alias("known"), (-x).alias("down"), i.alias("i"), x.alias("score"))))

        def told(ranked: Column) -> Column:
            best = F.get(ranked, 0)
            margin = F.when(F.size(s) > 1, best["score"] - F.get(ranked, 1)["score"]).otherwise(F.lit(float("inf")))
            return F.struct(best["i"].alias("sentence"), best["score"].alias("score"), margin.alias("margin"), third(best["i"], F.size(s)).alias("bucket"), (margin < ambiguous).alias("ambiguous"), F.size(s).alias("sentences"))

        return F.when(F.size(s) > 0, T.bound(by_score, told))

    return T.bound(scores, of)


def binned(value: Column, bounds: tuple[float, ...]) -> Column:
    """`lo-hi` by upper bounds, the last bin `>hi`."""
    out, low = F, "0"
    for b in bounds:
        out = out.when(value <= b, f"{low}-{b}")
        low = str(b)
    return out.otherwise(f">{low}")


def concepts(token_array: Column, entities: Column, most: int = 24) -> Column:
    """What a text is about: entities, numbers and units as they come, then content terms by falling count and by name; each
    once, `most` at most."""

    def counted(terms: Column) -> Column:
        """The different terms by falling count, then by name: of sorted terms each run's length is the way to the next run."""
        starts = T.bound(terms, lambda s: F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i))))
        runs = T.bound(starts, lambda at: F.transform(at, lambda i, k: F.struct((i - F.coalesce(F.get(at, k + 1), F.size(terms))).alias("k"), F.get(terms, i).alias("t"))))
        return F.transform(F.array_sort(runs), lambda c: c["t"])

    def of(t: Column) -> Column:
        return F.slice(F.array_distinct(F.concat(entities, T.numbers(t), T.units(t), T.bound(F.array_sort(T.content(t)), counted))), 1, most)

    return T.bound(token_array, of)


def covered(concept_terms: Column, query_terms: Column) -> Column:
    """Which concepts (arrays of terms) have all their terms among those of the queries."""
    return F.transform(concept_terms, lambda c: F.size(F.array_except(c, query_terms)) == 0)
