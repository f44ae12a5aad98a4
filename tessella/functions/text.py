"""Text functions, Column to Column; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
_DIRECTIONS = r"^(?:\s*(?:\([^)]*\)|\[[^\]]*\]))+"


def words(x: Column) -> Column:
    """White-space words; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def squeeze(x: Column) -> Column:
    """Trimmed, with single spaces."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def first_word(x: Column) -> Column:
    """The first word after leading stage directions, lower-case, without edge punctuation; empty if none."""
    return F.coalesce(F.lower(F.regexp_replace(F.get(words(F.regexp_replace(x, _DIRECTIONS, "")), F.lit(0)), _EDGE, "")), F.lit(""))


def word_set(x: Column) -> Column:
    """Distinct lower-case words without edge punctuation."""
    return F.array_distinct(F.filter(F.transform(words(x), lambda w: F.lower(F.regexp_replace(w, _EDGE, ""))), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def first_words(x: Column, n: int) -> Column:
    w = words(x)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(" ..."))).otherwise(F.array_join(w, " "))


def last_words(x: Column, n: int) -> Column:
    w = words(x)
    return F.when(F.size(w) > n, F.concat(F.lit("... "), F.array_join(F.slice(w, -n, n), " "))).otherwise(F.array_join(w, " "))


def tokens(x: Column) -> Column:
    """Runs of two or more word characters, lower-case."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ngrams(arr: Column, n: int) -> Column:
    """Space-joined runs of n elements; none if there are fewer."""
    none = F.array().cast("array<string>")
    return let(arr, lambda a: F.when(F.size(a) < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.array_join(F.slice(a, i, n), " "))))


def gram_hash(gram: Column) -> Column:
    """A 64-bit hash of an array of tokens."""
    return F.xxhash64(gram)


def hashed_ngrams(arr: Column, n: int) -> Column:
    """gram_hash() of each run of n elements; none if there are fewer."""
    none = F.array().cast("array<bigint>")
    return let(arr, lambda a: F.when(F.size(a) < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: gram_hash(F.slice(a, i, n)))))


def shingles(arr: Column, k: int) -> Column:
    """Distinct 64-bit hashes of k-word runs; a shorter text has one of all its words, an empty one none."""
    none = F.array().cast("array<bigint>")
    runs = let(arr, lambda a: F.when(F.size(a) == 0, none).when(F.size(a) < k, F.array(gram_hash(a))).otherwise(F.transform(F.sequence(F.lit(1), F.size(a) - k + 1), lambda i: gram_hash(F.slice(a, i, k)))))
    return F.array_distinct(runs)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def markdown_cell(x: Column) -> Column:
    """A value as a cell of a Markdown table: bars escaped, line ends as spaces, null as nothing."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(x.cast("string"), r"\|", r"\\|"), r"\s*\R\s*", " "), F.lit(""))


def looks_truncated(x: Column) -> Column:
    """The text doesn't end with a sentence's end or a closing mark."""
    return ~F.coalesce(F.right(F.trim(x), F.lit(1)).isin(list(".!?)\"'”’")), F.lit(False))


def seed_of(x: Column) -> Column:
    """The first 8 hex digits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(x, 256), 1, 8), 16, 10).cast("long")


def index_of(x: Column, n: Column) -> Column:
    """The first 8 digest bytes, as an unsigned number, modulo n."""
    return (F.conv(F.substring(F.sha2(x, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


def redact(x: Column, names: list[str], placeholder: str = "[NAME]") -> Column:
    """Replace the names, longest first, where no word goes on at either side; a preceding honorific goes too."""
    import re

    alternatives = "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n)))
    return F.regexp_replace(x, rf"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr|Senator|President)\.?\s+)?(?:{alternatives})(?!\w)", placeholder)


def contains_run(needle: Column, haystack: Column) -> Column:
    """Whether one token array occurs as a run within another."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return F.contains(pad(haystack), pad(needle))


def era_violations(x: Column, year: Column) -> Column:
    """Year numbers in the text that lie after the given year."""
    return F.filter(F.regexp_extract_all(x, F.lit(r"\b(?:19|20)\d\d\b"), F.lit(0)), lambda y: y.cast("int") > year)


def is_capitalised(token: Column) -> Column:
    return token.rlike(r"^[^\p{L}\p{N}]*\p{Lu}")


def entity_density(x: Column) -> Column:
    """Share of words that are capitalised inside a sentence, or numbers."""
    w = words(x)
    hit = F.transform(w, lambda t, i: (is_capitalised(t) & (i > 0) & ~F.coalesce(F.get(w, i - 1).rlike(r"[.!?][\"')]*$"), F.lit(False))) | t.rlike(r"^\W*\d"))
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.filter(hit, lambda h: h)) / F.size(w))


def density_bucket(d: Column) -> Column:
    """Z up to .02, L up to .08, H above; both edges belong to the lower bucket."""
    return F.when(d <= 0.02, "Z").when(d <= 0.08, "L").otherwise("H")


def transcript_cells(cell: Column) -> Column:
    """Structs of id, date, program, cluster and substance; a program may hold the separator."""
    pattern = r"([A-Za-z][A-Za-z0-9]*-\d+)\|(\d{4}-\d\d-\d\d)\|(.*?)\|(cl\d+)\|([S-])(?=;|$)"
    part = lambda k: F.regexp_extract_all(cell, F.lit(pattern), F.lit(k))
    zipped = F.arrays_zip(*[part(k).alias(n) for k, n in enumerate(("transcript_id", "date", "program", "cluster_id", "flag"), 1)])
    return F.transform(zipped, lambda s: F.struct(s["transcript_id"].alias("transcript_id"), s["date"].cast("date").alias("date"), s["program"].alias("program"), s["cluster_id"].alias("cluster_id"), (s["flag"] == "S").alias("substantive")))


def decode_pairs(x: Column) -> Column:
    """A map of codes to labels from text such as '1=Male, 2=Female'; labels may hold commas."""
    pattern = r"(\d+)\s*=\s*(.*?)\s*(?=,\s*\d+\s*=|$)"
    return F.map_from_arrays(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda k: k.cast("int")), F.regexp_extract_all(x, F.lit(pattern), F.lit(2)))


def title_case(x: Column) -> Column:
    """Each run of letters with a capital first letter."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 20)))), "")


def name_key(x: Column) -> Column:
    """Lower-case name tokens without honorifics and punctuation, joined by spaces."""
    plain = F.regexp_replace(F.lower(x), r"^(?:(?:mr|mrs|ms|dr|prof|sen|rep|gov|president|senator)\.?\s+)+", "")
    return squeeze(F.regexp_replace(plain, r"[^\p{L}\p{N}\s]", ""))


def speaker(label: Column) -> Column:
    """Struct of kind (host, guest, other) and name from a label such as 'JOHN DOE, HOST'."""
    name = title_case(squeeze(F.regexp_replace(F.substring_index(label, ",", 1), r"\(.*?\)", "")))
    up = F.upper(label)
    kind = F.when(up.rlike(r"\b(HOST|ANCHOR|CORRESPONDENT)\b"), "host").when(up.rlike(r"\b(UNIDENTIFIED|ANNOUNCER|CROWD)\b"), "other").otherwise("guest")
    return F.struct(kind.alias("kind"), name.alias("name"))


def titled_speaker(label: Column, honorifics: list[str]) -> Column:
    """speaker() with the title before the name as ``honorific``, lower-case, or null."""
    pattern = r"(?i)^\s*(" + "|".join(sorted(honorifics, key=lambda h: (-len(h), h))) + r")\.?\s+"
    s = speaker(F.regexp_replace(label, pattern, ""))
    title = F.lower(F.regexp_extract(label, pattern, 1))
    return F.struct(s["kind"].alias("kind"), s["name"].alias("name"), F.when(title != "", title).alias("honorific"))


def question_type(x: Column, cues: dict[str, list[str]]) -> Column:
    """The type with most cues in the text (ties: the first type); unclear without any. A cue inside a longer cue of the text doesn't count."""
    low = F.lower(x)
    every = sorted({c for cs in cues.values() for c in cs})
    present = {c: F.contains(low, F.lit(c)) for c in every}
    counted = {}
    for kind, cs in cues.items():
        total = F.lit(0)
        for c in cs:
            longer = F.lit(False)
            for o in every:
                if o != c and c in o:
                    longer = longer | present[o]
            total = total + F.when(present[c] & ~longer, 1).otherwise(0)
        counted[kind] = total
    best = F.greatest(*counted.values()) if len(counted) > 1 else next(iter(counted.values()))
    out = F.when(best == 0, "unclear")
    for kind, n in counted.items():
        out = out.when(n == best, kind)
    return out


def truncate_answer(x: Column, most: int = 400, target: int = 300) -> Column:
    """Struct of text and whether it was cut. A text of more than ``most`` words ends at the sentence end nearest ``target`` words.

    If that end would cut nothing or still leave too many words, or there is
    none, the first ``target`` words are kept.
    """
    ends = r"[.!?]+[\"')\]”’]*"
    t = F.trim(F.coalesce(x, F.lit("")))

    def cut(text: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(rf"(?s).+?{ends}(?=\s|$)|.+$"), F.lit(0))
        sums = F.aggregate(parts, F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + word_count(p))))
        gaps = F.transform(sums, lambda n, i: F.when(F.get(parts, i).rlike(rf"{ends}$"), F.abs(n - target)))
        at = F.array_position(gaps, F.array_min(gaps)).cast("int")
        kept = F.get(sums, at - 1)
        head = F.trim(F.array_join(F.slice(parts, F.lit(1), at), ""))
        return F.when((kept < word_count(text)) & (kept <= most), head).otherwise(F.array_join(F.slice(words(text), 1, target), " "))

    long = word_count(t) > most
    return F.struct(F.when(long, let(t, cut)).otherwise(t).alias("text"), long.alias("truncated"))
