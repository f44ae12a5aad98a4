"""Scrubbers of names, affiliations and address, and guards over prompts.

Where a rule looks at neighbouring words or clauses, it is plain Python over one
text, run in Arrow batches; the rest are Column functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME, NUMBER, DESCRIPTION = "[NAME]", "[NUMBER]", "[DESCRIPTION REMOVED]"

# Titles before names, role words, abbreviations, address openers, and the patterns they are part of.
HONORIFICS = frozenset(
    "DR MR MRS MS MISS MX SEN SENATOR REP REPRESENTATIVE CONGRESSMAN CONGRESSWOMAN GOV GOVERNOR PRES PRESIDENT PROF PROFESSOR GEN GENERAL COL COLONEL LT LIEUTENANT LIEUT SGT SERGEANT MAJ MAJOR CPL CORPORAL CAPT "
    "CAPTAIN ADM ADMIRAL CMDR COMMANDER REV REVEREND FR FATHER RABBI IMAM SHEIKH SHEIK JUDGE JUSTICE MAYOR AMBASSADOR AMB SECRETARY SEC DEAN SIR DAME LORD LADY PRINCE PRINCESS KING QUEEN POPE ARCHBISHOP BISHOP "
    "CARDINAL DETECTIVE DET OFFICER CHIEF SUPERINTENDENT COACH DOCTOR PASTOR BROTHER SISTER MOTHER AYATOLLAH COUNSELOR DELEGATE ASSEMBLYMAN ASSEMBLYWOMAN COUNCILMAN COUNCILWOMAN".split()
)
ROLES = (
    "professor", "prof", "author", "co-author", "chairman", "chairwoman", "chair", "director", "fellow", "correspondent", "analyst", "ambassador", "secretary", "official", "officer", "editor", "columnist", "founder",
    "dean", "scholar", "researcher", "adviser", "advisor", "reporter", "anchor", "expert", "specialist", "scientist", "historian", "novelist", "writer", "attorney", "lawyer", "senator", "congressman", "congresswoman",
    "governor", "minister", "president", "vice president", "commissioner", "spokesman", "spokeswoman", "economist", "psychologist", "sociologist", "physician", "surgeon", "curator", "producer", "publisher", "critic",
    "strategist", "diplomat", "veteran", "professor emeritus", "lecturer", "head of", "chief", "co-founder", "general counsel", "consultant",
)
OPENERS = ("you know", "look", "well look", "as you said", "as you say", "as you know", "as you point out", "as you pointed out", "you're right", "you are right", "that's right", "sure", "well", "right", "yeah", "oh")
RETAIN = 0.70

_LEAD, _TRAIL = "\"'“”‘’([{\\-–—*", ",.;:!?)\\]}\"'“”‘’\\-–—*"
_PARTS = re.compile(f"^([{_LEAD}]*)(.*?)([{_TRAIL}]*)$", re.S)
_PRONOUN = re.compile(r"I(?:['’](?:m|ve|d|ll))?")
_ROLE = re.compile(r"\b(?:" + "|".join(map(re.escape, ROLES)) + r")\b", re.I)
_APPOSITIVE = re.compile(r"GUEST(?:'s)?,\s+([^,.;]{3,120})(?=[,.;])|GUEST\s+is\s+([^.;]{3,160})(?=[.;])|GUEST,\s+(?:as\s+)?an?\s+([^,.;]{3,120})(?=[,.;])")
_WHO = re.compile(r"GUEST,\s+(who\b[^.;?!]{3,300})(?=[.;?!])")
_PROPER = re.compile(r"\b[A-Z][a-z]{2,}")
_ADDRESSED = re.compile(r"\b(?:you|your|you're|you've|yourself)\b", re.I)
_ABBREVIATION = re.compile(r"(?:\b(?:[A-Za-z]\.){2,}|\b(?:Mr|Mrs|Ms|Dr|Prof|Sen|Rep|Gov|Gen|Amb|Lt|Col|Sgt|St|Jr|Sr|Inc|Corp|Ltd|Univ)\.)(?=[,;:)\-]|\s+[a-z])")
_ADDRESS = re.compile(r"\b(?:as you (?:said|say|know|note|noted|point out|pointed out)|you(?:'re| are) right|you know)\b[,\s]*", re.I)
#: Stands for an abbreviation's full stop while clauses are sought.
_DOT = "\x00"


def abbreviated(core: str) -> bool:
    """Whether a full stop after the token would be an abbreviation's: a title, an inner full stop, or an initial."""
    letters = core.replace(".", "")
    return bool(letters) and (len(letters) == 1 or "." in core or letters.upper() in HONORIFICS)


def entities(text: str | None) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """The text's tokens (lead, core, trail) in runs: a name, a number, or other words.

    A name is a run of capitalised words within a sentence, but a single one at
    a sentence's start tells nothing. "I" and placeholders are never names. A
    number has two digits or more, or is an amount.
    """
    tokens = [_PARTS.match(t).groups() for t in (text or "").split()]
    own = [core in ("NAME", "NUMBER") and lead.endswith("[") and trail.startswith("]") for lead, core, trail in tokens]
    capital = ["A" <= core[:1] <= "Z" and not o and not _PRONOUN.fullmatch(core) for (_, core, _), o in zip(tokens, own, strict=True)]

    def ends(core: str, trail: str) -> bool:
        tail = core[-1:] + trail
        return "!" in tail or "?" in tail or "." in tail and not abbreviated(core)

    starts = [i == 0 or ends(*tokens[i - 1][1:]) for i in range(len(tokens))]
    run, number = [], 0
    for i, c in enumerate(capital):
        number += not (c and i and capital[i - 1] and not starts[i])
        run.append(number)
    found = []
    for _, members in groupby(range(len(tokens)), key=run.__getitem__):
        at = list(members)
        if capital[at[0]] and (len(at) > 1 or not starts[at[0]]):
            found.append(("name", [tokens[i] for i in at]))
            continue
        for i in at:
            core = tokens[i][1]
            digits = sum(c.isdigit() for c in core)
            found.append(("number" if not own[i] and (digits > 1 or digits and ("$" in core or "%" in core)) else "word", [tokens[i]]))
    return found


def strip_entities(text: str | None) -> str:
    """Names and numbers replaced by placeholders, with the punctuation around them; doing it twice changes nothing more."""
    said = {"name": NAME, "number": NUMBER}
    return " ".join(f"{t[0][0]}{said[kind]}{t[-1][2]}" if kind in said else "".join(t[0]) for kind, t in entities(text))


def density(text: str | None) -> float:
    """The share of tokens that are part of a name or number; 0 without tokens."""
    runs = entities(text)
    total = sum(len(t) for _, t in runs)
    return sum(len(t) for kind, t in runs if kind != "word") / total if total else 0.0


def _described(clause: str) -> str:
    """A "who" clause as far as it describes the guest: further comma segments count while they name a role or a proper noun and don't turn to the guest."""
    first, *others = re.split(r"(,\s*)", clause)
    kept = first
    for comma, segment in zip(others[::2], others[1::2], strict=True):
        if _ADDRESSED.search(segment) or not (_ROLE.search(segment) or _PROPER.search(segment)):
            break
        kept += comma + segment
    return kept


def scrub_line(text: str) -> tuple[str, int]:
    """A spoken line with the guest's descriptions removed where they name a role, and how many."""
    removed = 0

    def replaced(m: re.Match, part: Callable[[str], str]) -> str:
        nonlocal removed
        body = part(next(g for g in m.groups() if g))
        if not _ROLE.search(body):
            return m[0]
        removed += 1
        return m[0].replace(body, DESCRIPTION, 1)

    masked = _ABBREVIATION.sub(lambda m: m[0].replace(".", _DOT), text)
    masked = _WHO.sub(lambda m: replaced(m, _described), masked)
    masked = _APPOSITIVE.sub(lambda m: replaced(m, str), masked)
    return masked.replace(_DOT, "."), removed


def scrub_affiliations(prompt: str | None) -> tuple[str, int]:
    """scrub_line() on the lines of HOST and GUEST; all else stays."""
    lines, total = (prompt or "").splitlines(), 0
    for i, line in enumerate(lines):
        for speaker in ("HOST: ", "GUEST: "):
            if line.startswith(speaker):
                said, n = scrub_line(line[len(speaker) :])
                lines[i], total = speaker + said, total + n
                break
    return "\n".join(lines), total


def host_forms(labels: Sequence[str]) -> list[str]:
    """Names to strip, longest first: each label's full name, and its tokens of three letters or more."""
    found: set[str] = set()
    for label in labels:
        tokens = [t for t in label.split(",")[0].split() if t.replace(".", "").isalpha()]
        found |= {" ".join(tokens), *(t for t in tokens if len(t) > 2)} if tokens else set()
    return sorted(found, key=lambda f: (-len(f), f))


def _tidied(text: str) -> str:
    """Repairs the punctuation that a removal leaves."""
    out = " ".join(text.split())
    for pattern, by in ((r"\s+([,;:.!?])", r"\1"), (r",\s*([.!?])", r"\1"), (r"([,;:])\s*\1+", r"\1"), (r",\s*,", ","), (r"\s{2,}", " ")):
        out = re.sub(pattern, by, out)
    return out.strip().lstrip(",;: ").strip()


def strip_address(text: str | None, forms: Sequence[str]) -> str:
    """Without the host's name, openers that address the host, and asides to the host; the first letter is a capital."""
    out = " ".join((text or "").split())
    for form in forms:
        out = re.sub(rf"(?:^|(?<=[\s,;:])){re.escape(form)}\b[\s,]*", " ", out, flags=re.I)
    opener = re.compile(r"\s*(?:" + "|".join(sorted(map(re.escape, OPENERS), key=lambda o: (-len(o), o))) + r")\b[\s,]*", re.I)
    while m := opener.match(out):
        out = out[m.end() :]
    out = _tidied(_ADDRESS.sub(" ", out))
    return out[:1].upper() + out[1:]


def strip_set(texts: Sequence[str | None], forms: Sequence[str], retain: float = RETAIN) -> tuple[list[str], bool]:
    """All options stripped, or none: if any would lose more than the rest that must be retained, the set stays as it is. And whether it was stripped."""
    plain = [" ".join((t or "").split()) for t in texts]
    stripped = [strip_address(t, forms) for t in plain]
    words = lambda t: len(t.split())
    if any(not b or words(a) and words(b) / words(a) < retain for a, b in zip(plain, stripped, strict=True)):
        return plain, False
    return stripped, True


@F.pandas_udf(T.StringType())
def entity_free(text: pd.Series) -> pd.Series:
    return text.map(strip_entities, na_action=None)


@F.pandas_udf(T.DoubleType())
def entity_density(text: pd.Series) -> pd.Series:
    return text.map(density, na_action=None)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())]))
def unaffiliated(prompt: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scrub_affiliations(p) for p in prompt], columns=["text", "removed"])


@F.pandas_udf(T.StructType([T.StructField("options", T.ArrayType(T.StringType())), T.StructField("stripped", T.BooleanType())]))
def undirected(options: pd.Series, labels: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([strip_set(list(o), host_forms(list(x))) for o, x in zip(options, labels, strict=True)], columns=["options", "stripped"])


#: What a forced choice leaves in a prompt.
_RESIDUE = {"choice_line": r"Which of these replies did", "distribution_instruction": r"Give a probability for each option", "option_line": r"(?m)^[A-Z]\.\s+\S"}


def choice_residue(prompt: Column) -> Column:
    """The kinds of forced-choice material that the prompt still holds."""
    return F.filter(F.array(*[F.when(prompt.rlike(p), F.lit(k)) for k, p in _RESIDUE.items()]), lambda x: x.isNotNull())


def tail(prompt: Column) -> Column:
    """The last block of a prompt."""
    return F.try_element_at(F.split(prompt, "\n\n"), F.lit(-1))


def survivors(text: Column, names: Sequence[str]) -> Column:
    """The names that a text still holds as whole words, whatever their case, in their given order."""
    return F.filter(F.array(*[F.when(F.lower(text).rlike(rf"(?<!\w){re.escape(n.lower())}(?!\w)"), F.lit(n)) for n in names]), lambda x: x.isNotNull())
