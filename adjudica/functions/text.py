"""Text extraction and normalisation for decision documents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from adjudica.constants import FIELD_LABELS, INCIDENT_TYPE_KEYWORDS
from adjudica.functions.blanks import WS, as_col, or_empty, strip

ODD_SPACES = "\u00a0\ufffd"
#: White space other than the blank.
_NO_BLANK = r"\t-\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _runs(more: str = "") -> str:
    """White space and ``more``, save single spaces; printable characters, nearly all, are passed over by one comparison."""
    return rf"(?![!-~])(?! [!-~])(?:[ {_NO_BLANK}{more}]{{2,}}|[{_NO_BLANK}{more}])"


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | text.contains(term)
    return hit


def squeeze(value: Column) -> Column:
    """Every run of white space becomes one space; single spaces are left where they are."""
    return F.regexp_replace(value, _runs(), " ")


def normalize_text(value: Column | str) -> Column:
    return F.trim(F.regexp_replace(or_empty(value), _runs(ODD_SPACES), " "))


def plain_spaces(value: Column | str) -> Column:
    """Text as the label lexer reads it. Make it a column of its own where several fields are taken from it."""
    text = or_empty(value)
    for odd in ODD_SPACES:
        text = F.replace(text, F.lit(odd), F.lit(" "))
    return text


def lowered(text: Column | str) -> Column:
    """Lower case in which every character keeps its place; the few that grow are left as they are."""
    low = F.lower(text)
    return F.when(F.length(low) == F.length(text), low).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


_STOPS = f"(?:{'|'.join(FIELD_LABELS)})"
#: A block from behind its label on: at least a line, and all lines before the next label on a line of its own.
_BLOCK = rf"{WS}*\n([^\n]++(?:\n(?!{_STOPS}{WS}*\n)[^\n]*+)*+)"


def _name(label: str) -> str:
    return re.escape(label).replace("\\ ", " ")


def _searched(text: Column, label: str) -> Column:
    """The field wherever its label stands: under the label, else behind it in its line."""
    name = _name(label)
    block = F.regexp_extract(text, rf"(?is){name}{WS}*\n(.+?)(?=\n{_STOPS}{WS}*\n|\z)", 1)
    inline = F.regexp_extract(text, rf"(?is){name}{WS}+(.+?)(?={WS}+{_STOPS}{WS}+|\z)", 1)
    return F.when(block != "", block).otherwise(inline)


def _searched_reason(text: Column) -> Column:
    block = F.regexp_extract(text, rf"(?is)Reason{WS}*\n(.+)", 1)
    inline = F.regexp_extract(text, rf"(?is)Reason{WS}+(.+?)(?=Competitors are reminded|Decisions of the Stewards|\z)", 1)
    return F.when(block != "", block).otherwise(inline)


def cut_field(text: Column, label: str) -> Column:
    """Body of a labelled field of ``plain_spaces`` text: a block under the label, else the rest of its line.

    One match ends at the first place of the label, with the block that begins there. Only a label that stands in a line
    before it has a block, or has none, is searched for in the whole text.
    """
    if label.lower() == "reason":
        own = F.nullif(F.regexp_extract(text, rf"(?is)Reason(?:{WS}*\n(.+))?", 1), F.lit(""))
        return normalize_text(F.split_part(F.coalesce(own, _searched_reason(text)), F.lit("Competitors are reminded"), F.lit(1)))
    own = F.nullif(F.regexp_extract(text, rf"(?i){_name(label)}(?:{_BLOCK})?", 1), F.lit(""))
    return normalize_text(F.coalesce(own, _searched(text, label)))


def field_of(text: Column, low: Column, label: str) -> Column:
    """``cut_field`` where the lower-case text is at hand: one without the label is not matched."""
    return F.when(low.contains(label.lower()), cut_field(text, label)).otherwise("")


def extract_field(text: Column | str, label: str) -> Column:
    """``cut_field`` for a single field of a raw text."""
    return cut_field(plain_spaces(text), label)


def time_of(text: Column, low: Column) -> Column:
    """``last_time_field`` where the lower-case text is at hand."""
    return F.when(low.contains("\ntime"), last_time_field(text)).otherwise("")


def last_time_field(text: Column | str) -> Column:
    """The last ``Time`` block: the incident's own time rather than the header clock."""
    stop = "|".join(FIELD_LABELS)
    blocks = F.regexp_extract_all(
        or_empty(text), F.lit(rf"(?is)\nTime{WS}*\n(.+?)(?=\n(?:{stop}){WS}*\n|\z)"), F.lit(1))
    return normalize_text(F.element_at(F.concat(F.array(F.lit("")), blocks), -1))


def loose_title(title: Column | str) -> Column:
    return F.trim(squeeze(F.regexp_replace(F.lower(or_empty(title)), r"[_\-.]+", " ")))


def document_type(title: Column | str) -> Column:
    text = loose_title(title)

    def named(name: str) -> Column:
        return text.rlike(rf"\b{name}\b")

    # One chain, in which the title is put in order once.
    return (F.when(named("summons"), "summons").when(named("infringement"), "infringement").when(named("offence"), "offence")
            .when(named("decision"), "decision").otherwise("unknown"))


def title_for_matching(title: Column | str) -> Column:
    stem = F.regexp_replace(or_empty(title), r"(?i)(?<=.)\.pdf$", "")
    return loose_title(stem)


def has_keyword(title: Column | str, keywords: Sequence[str]) -> Column:
    text = title_for_matching(title)
    hit = F.lit(False)
    for keyword in keywords:
        hit = hit | text.rlike(rf"\b{re.escape(keyword.lower())}\b")
    return hit


def title_included(title: Column | str, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Whole-word include list minus a substring exclude list.

    ``provisional`` never excludes, and a correction of an included title is kept.
    """
    lowered = F.lower(or_empty(title))
    terms = [term.lower() for term in exclude if term.lower() != "provisional"]
    included = has_keyword(title, include)
    return included & (~contains_any(lowered, terms) | lowered.contains("correction"))


def document_session(value: Column | str) -> Column:
    text = F.lower(strip(or_empty(value)))
    return (
        F.when(text.contains("race"), "race")
        .when(text.contains("qualifying"), "qualifying")
        .when(text.contains("sprint"), "sprint")
        .when(text.rlike("practice [123]"), "practice")
        .otherwise(text)
    )


def rule_session(value: Column | str) -> Column:
    """Session token for rules; qualifying is tested before sprint."""
    text = F.lower(strip(or_empty(value)))
    return (
        F.when(text.contains("qualifying"), "qualifying")
        .when(text.contains("sprint"), "sprint")
        .when((text == "race") | text.startswith("race "), "race")
        .when(text.contains("practice"), "practice")
        .otherwise(text)
    )


def car_number(line: Column | str) -> Column:
    return F.regexp_extract(strip(or_empty(line)), rf"^(\d+){WS}*[-\u2013]{WS}*(.+)", 1)


def car_driver(line: Column | str) -> Column:
    text = strip(or_empty(line))
    name = strip(F.regexp_extract(text, rf"^(\d+){WS}*[-\u2013]{WS}*(.+)", 2))
    return F.when(car_number(text) != "", name).otherwise(text)


def opponent_cars(fact: Column | str, own_car: Column | str | None = None) -> Column:
    cars = F.array_sort(F.array_distinct(
        F.regexp_extract_all(or_empty(fact), F.lit(rf"(?i)\bcar{WS}+(\d+)\b"), F.lit(1))))
    return cars if own_car is None else F.array_remove(cars, or_empty(own_car))


def turn_number(fact: Column | str) -> Column:
    return F.regexp_extract(or_empty(fact), rf"(?i)\bturn{WS}+(\d+)\b", 1)


def penalty_points(decision: Column | str) -> Column:
    return F.regexp_extract(or_empty(decision), rf"(?i)(\d+){WS}+penalty{WS}+points?", 1)


def penalty_label(decision: Column | str) -> Column:
    text = F.lower(normalize_text(decision))
    places = F.regexp_extract(text, r"(\d+)\s+place", 1)
    seconds = F.regexp_extract(text, r"(\d+)\s+second", 1)
    return (
        F.when(text == "", "")
        .when(contains_any(text, ["no further action", "no action"]), "no_further_action")
        .when(text.contains("reprimand"), "reprimand")
        .when(text.contains("warning"), "warning")
        .when(contains_any(text, ["disqualified", "disqualification"]), "disqualification")
        .when(text.contains("grid") & text.contains("place"),
              F.when(places != "", F.concat(places, F.lit("_place_grid_drop")))
              .otherwise("grid_penalty"))
        .when(text.contains("time penalty") | text.rlike(r"\b\d+\s+second"),
              F.when(seconds != "", F.concat(seconds, F.lit("s_time_penalty")))
              .otherwise("time_penalty"))
        .when(text.contains("drive through"), "drive_through")
        .otherwise(F.substring(F.replace(text, F.lit(" "), F.lit("_")), 1, 80))
    )


def driver_at_fault(reason: Column | str, fact: Column | str) -> Column:
    both = F.lower(normalize_text(F.concat(or_empty(reason), F.lit(" "), or_empty(fact))))
    car = F.regexp_extract(or_empty(reason), rf"(?i)car{WS}+(\d+)", 1)
    blamed = contains_any(both, ["wholly to blame", "predominantly to blame"])
    return (
        F.when(both.contains("no driver was wholly or predominantly to blame"), "none")
        .when(blamed & (car != ""), F.concat(F.lit("car_"), car))
        .otherwise("")
    )


def grand_prix(text: Column | str) -> Column:
    return strip(F.regexp_extract(or_empty(text), rf"(?i)(\d{{4}}){WS}+(.+?{WS}GRAND PRIX)", 2))


def slug(name: Column | str) -> Column:
    text = F.regexp_replace(F.lower(strip(or_empty(name))), "[^a-z0-9]+", "_")
    return F.regexp_replace(text, "^_+|_+$", "")


def incident_type(fact: Column | str, offence: Column | str,
                  keywords: Mapping[str, Sequence[str]] = INCIDENT_TYPE_KEYWORDS) -> Column:
    text = F.lower(F.concat(or_empty(fact), F.lit(" "), or_empty(offence)))
    kind = F.lit("other")
    for name, terms in reversed(list(keywords.items())):
        kind = F.when(contains_any(text, terms), name).otherwise(kind)
    return kind


def normalize_fact(fact: Column | str) -> Column:
    return F.trim(squeeze(F.lower(or_empty(fact))))


def incident_id(season: Column | str, session: Column | str, car: Column | str,
                fact: Column | str, event: Column | str | None = None) -> Column:
    """season_session_digest; passing ``event`` keeps equal texts at two events apart."""
    season, session = as_col(season).cast("string"), or_empty(session)
    parts = [season, session, or_empty(car), normalize_fact(fact)]
    if event is not None:
        parts.append(or_empty(event))
    digest = F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10)
    return F.concat_ws("_", season, session, digest)


def document_id(season: Column | str, event_slug: Column | str, title: Column | str) -> Column:
    season = as_col(season).cast("string")
    digest = F.substring(F.sha1(F.concat_ws("|", season, or_empty(event_slug), or_empty(title))), 1, 12)
    return F.concat_ws("_", season, or_empty(event_slug), digest)


def unescape(text: Column) -> Column:
    """The HTML entities that occur in titles."""
    # Entity -> character; the ampersand must come last.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def title_key(name: Column | str) -> Column:
    stem = F.regexp_replace(or_empty(name), r"(?i)\.pdf$", "")
    return F.regexp_replace(F.lower(unescape(stem)), "[^a-z0-9]+", "")


def _accent_pairs() -> tuple[str, str]:
    source, plain = [], []
    for code in range(0x00C0, 0x0250):
        folded = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            source.append(chr(code))
            plain.append(folded)
    return "".join(source), "".join(plain)


def fold_accents(value: Column | str) -> Column:
    """Latin letters without their accents; other non-ASCII characters vanish."""
    return F.regexp_replace(F.translate(or_empty(value), *_accent_pairs()), r"[^\x00-\x7f]", "")


def event_name(name: Column | str) -> Column:
    text = F.lower(fold_accents(F.translate(or_empty(name), "\u00a0", " ")))
    text = F.regexp_replace(text, r"\bformula\s*(1|one)\b", " ")
    text = F.replace(text, F.lit("grand prix"), F.lit(" "))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def event_token(event: Column | str) -> Column:
    return F.trim(squeeze(F.replace(F.lower(or_empty(event)), F.lit("grand prix"), F.lit(""))))


def event_stem(event: Column | str) -> Column:
    """Lower-case event without its suffix, as used by the local calendar lookup."""
    return strip(F.replace(F.lower(or_empty(event)), F.lit("grand prix"), F.lit("")))


def nationality_slug(value: Column | str) -> Column:
    return F.replace(F.lower(strip(or_empty(value))), F.lit(" "), F.lit("_"))


def id_slug(value: Column | str) -> Column:
    return F.replace(F.lower(or_empty(value)), F.lit("-"), F.lit("_"))


def section(tag: str, body: Column | str) -> Column:
    """``[TAG] body``, or NULL for an empty body so that concat_ws skips it."""
    # Not a condition on the text, which would be normalised again behind it.
    return F.concat(F.lit(f"[{tag}] "), F.nullif(normalize_text(body), F.lit("")))


def truncate(text: Column | str, max_length: int) -> Column:
    """Head...tail cut to four characters per token."""
    text = or_empty(text)
    if max_length <= 0:
        return F.lit("")
    limit = max(max_length * 4, 1)
    head = limit // 2
    tail = max(limit - head - 3, 0)
    cut = F.concat(F.left(text, F.lit(head)), F.lit("..."), F.right(text, F.lit(tail))) \
        if tail else F.left(text, F.lit(limit))
    return F.when(F.length(text) <= limit, text).otherwise(cut)
