"""Text functions: columns in, columns out."""

import re
import unicodedata
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

def _plain_letters() -> dict[str, str]:
    """Letters up to U+1EFF and the Latin ligatures whose compatibility decomposition begins with ASCII letters, and these."""
    found = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if plain:
            found[chr(code)] = plain
    return found


PLAIN = _plain_letters()
#: Of these the letters that become one, by a table, and the others.
ONE = {k: v for k, v in PLAIN.items() if len(v) == 1}
MORE = {k: v for k, v in PLAIN.items() if len(v) > 1}


def words(c: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def unaccent(c: Column) -> Column:
    """Latin letters without accents, ligatures as letters; what else isn't ASCII is left out."""
    single = F.translate(c, "".join(ONE), "".join(ONE.values()))
    return F.regexp_replace(reduce(lambda col, p: F.replace(col, F.lit(p[0]), F.lit(p[1])), MORE.items(), single), r"[^\x00-\x7F]", "")


def slug(c: Column) -> Column:
    """An address part: unaccented, lower case, words joined by hyphens."""
    kept = F.lower(F.regexp_replace(unaccent(c), r"[^A-Za-z0-9_\s-]", ""))
    return F.btrim(F.regexp_replace(kept, r"[-\s]+", "-"), F.lit("-"))


def simple_slug(c: Column) -> Column:
    """Lower case, hyphens for spaces, no apostrophes."""
    return F.translate(F.lower(c), " '", "-")


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "‘’“”", "''\"\"")


def loose(c: Column) -> Column:
    """For comparing quotes: lower case, straight quotes, words and apostrophes alone, single spaces."""
    return F.trim(F.regexp_replace(F.lower(straight_quotes(c)), "[^a-z0-9']+", " "))


def no_punctuation(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s]", ""), r"\s+", " "))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z ]", "")


def spaces_for_hyphens(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s\-]+", " ")


def deflutter(c: Column) -> Column:
    """Repeated words collapsed to one."""
    return F.regexp_replace(c, r"(?i)\b(\w+)(\s+\1\b)+", "$1")


TITLES = ["Village Manager", "Town Supervisor", "Deputy Mayor", "Council Member", "Board Member", "Chairperson"]
TITLES += ["Trustee", "Mayor", "Supervisor", "Chairman", "Chairwoman", "Chair", "Judge", "Chief", "Clerk", "Dr.", "Mr.", "Mrs.", "Ms."]


def without_title(c: Column) -> Column:
    """The name after a title, the longest that fits."""
    ordered = sorted(TITLES, key=len, reverse=True)
    pattern = "|".join(t.replace(".", r"\.") for t in ordered)
    return F.regexp_replace(c, f"^(?i)({pattern})\\s+", "")


def title_of(c: Column) -> Column:
    """The title before a name; empty if none."""
    ordered = sorted(TITLES, key=len, reverse=True)
    pattern = "|".join(t.replace(".", r"\.") for t in ordered)
    return F.regexp_extract(c, f"^((?i)(?:{pattern}))\\s+", 1)


def surname(c: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(c), r"\s+"), -1))


def base_token(c: Column) -> Column:
    """A word without possessive ending and what follows a hyphen."""
    return F.regexp_replace(F.regexp_replace(straight_quotes(c), "'s$", ""), "-.*$", "")


def strip_markdown(c: Column) -> Column:
    """Links, emphasis, headings, rules and code marks removed."""
    steps = [
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^#{1,6}\s*", ""),
        (r"(?m)^\s*([-*_]\s*){3,}$", ""),
        (r"(\*\*|__|\*|`)", ""),
    ]
    return reduce(lambda col, s: F.regexp_replace(col, *s), steps, c)


def summary_line(c: Column, limit: int = 160) -> Column:
    """One line of at most ``limit`` characters, cut at a word with an ellipsis."""
    flat = F.trim(F.regexp_replace(strip_markdown(c), r"\s+", " "))
    cut = F.regexp_replace(F.substring(flat, 1, limit - 1), r"\s+\S*$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def markdown_to_html(c: Column) -> Column:
    """Headings, rules, bold, links and list items as HTML."""
    steps = [
        (r"(?m)^### (.*)$", "<h3>$1</h3>"),
        (r"(?m)^## (.*)$", "<h2>$1</h2>"),
        (r"(?m)^# (.*)$", "<h1>$1</h1>"),
        (r"(?m)^---+$", "<hr>"),
        (r"(?m)^[-*] (.*)$", "<li>$1</li>"),
        (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"),
        (r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>'),
    ]
    return reduce(lambda col, s: F.regexp_replace(col, *s), steps, c)


def expand_shortcodes(c: Column, event_id: Column) -> Column:
    """``{{quote:seconds}}`` and ``{{photo:event:seconds:caption}}`` as markup.

    A marker that repeats at once appears once; without an event id quotes are left out.
    """
    single = F.regexp_replace(c, r"(\{\{[^}]*\}\})(\s*\1)+", "$1")
    photo = F.regexp_replace(
        single, r"\{\{photo:([^:}]*):(\d+):([^}]*)\}\}", '<figure data-event="$1" data-at="$2">$3</figure>'
    )
    quote = F.regexp_replace(photo, r"\{\{quote:(\d+)\}\}", '<cite data-at="$1"></cite>')
    return F.when(event_id.isNull() | (event_id == ""), F.regexp_replace(photo, r"\{\{quote:\d+\}\}", "")).otherwise(quote)


def shortcodes(c: Column) -> Column:
    """The markers of a text as (kind, argument)."""
    kind, argument = (F.regexp_extract_all(c, F.lit(r"\{\{(quote|photo):([^}]*)\}\}"), F.lit(i)) for i in (1, 2))
    return F.zip_with(kind, argument, lambda k, a: F.struct(k.alias("kind"), a.alias("argument")))


def footnotes_to_anchors(c: Column) -> Column:
    """``[n]`` marks as anchors to their notes."""
    return F.regexp_replace(c, r"\[(\d{1,3})\]", '<sup><a href="#fn$1">$1</a></sup>')


def replace_all(c: Column, pairs: list[tuple[str, str]], pattern: bool = False) -> Column:
    """Replacements in the order given."""
    step = F.regexp_replace if pattern else (lambda col, a, b: F.replace(col, F.lit(a), F.lit(b)))
    return reduce(lambda col, p: step(col, p[0], p[1]), pairs, c)


#: Sounds that fill a pause, and a phrase that does unless one of the words after it is governed by it.
FILLERS, PHRASE = ["uh", "um"], "you know"
GOVERNED = "how if that what when where who why".split()


def without_fillers(c: Column, set_off: bool = False) -> Column:
    """Spoken fillers removed, each with its comma; "you know" stays before what it governs. With ``set_off`` a phrase between
    two commas takes both."""
    sounds = rf"(?i)\b(?:{'|'.join(FILLERS)})\b,?\s*"
    phrase = rf"\b{PHRASE},?\s+(?!{'|'.join(GOVERNED)})"
    if set_off:
        c = F.regexp_replace(c, rf",(\s+{PHRASE},\s+)(?!{'|'.join(GOVERNED)})", "$1")
    plain = F.regexp_replace(F.regexp_replace(c, sounds, ""), phrase, "")
    return F.trim(F.regexp_replace(plain, r"\s{2,}", " "))


ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def strip_tags(c: Column) -> Column:
    """Text without tags, common references decoded, single spaces."""
    decoded = replace_all(F.regexp_replace(c, "<[^>]+>", " "), list(ENTITIES.items()))
    return F.trim(F.regexp_replace(decoded, r"\s+", " "))


def clean_manuscript(c: Column) -> Column:
    """Words parted at line ends joined, margin notes and doubtful readings unmarked."""
    steps = [(r"-\n\s*", ""), (r"\[marg:\s*([^\]]*)\]", "$1"), (r"\[illegible\]", "…"), (r"\[\?([^\]]*)\]", "$1")]
    return reduce(lambda col, s: F.regexp_replace(col, *s), steps, c)


def is_generic_speaker(c: Column) -> Column:
    """Whether a speaker has no name: a numbered label, or none."""
    return F.coalesce(F.lower(F.trim(c)).rlike(r"^(speaker\b.*|unknown.*|)$"), F.lit(True))


def has_word(c: Column, word: Column) -> Column:
    """Whether a text has a word, whatever its case; the word is taken literally."""
    return F.coalesce(F.regexp_like(c, F.concat(F.lit(r"(?i)\b\Q"), word, F.lit(r"\E\b"))), F.lit(False))


def ids_of(c: Column) -> Column:
    """The distinct whole numbers of a list parted by commas; none for null."""
    # empty places don't come to the cast, as each that it can't take costs as much as many numbers
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x) != "")
    return F.array_distinct(F.array_compact(F.transform(parts, lambda x: F.trim(x).try_cast("bigint"))))


def reflowed(c: Column) -> Column:
    """A law's lines as blocks: an empty line parts blocks, a line of columns is a block of its own, a line that begins with a
    mark, a number or a section begins one, and what else follows is joined to the line before, hyphens at its end mended.

    Whether a line begins a block follows from it and the line before, so each gets a sign of that and all are joined at once.
    """
    tabular = r"\S {3,}\S"
    begins = r"^(?:§|\(?[0-9]+[.)]|\(?[A-Za-z][.)] |[A-Z][A-Z ]{3,}$|[-•*] )"
    new, goes_on = "\x1e", "\x1f"

    def signed(lines: Column) -> Column:
        def sign(line: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(lines, i - 1))
            parted = before.isNull() | (F.trim(before) == "") | F.rtrim(before).rlike(tabular)
            fresh = parted | F.rtrim(line).rlike(tabular) | F.trim(line).rlike(begins)
            return F.when(F.trim(line) == "", "").otherwise(F.concat(F.when(fresh, new).otherwise(goes_on), F.trim(line)))

        return F.array_join(F.transform(lines, sign), "")

    plain = F.translate(F.coalesce(c, F.lit("")), new + goes_on, "")
    whole = _then(F.split(plain, "\n"), signed)
    mended = F.replace(F.regexp_replace(whole, f"(?<=[a-z])-{goes_on}", ""), F.lit(goes_on), F.lit(" "))
    return F.filter(F.split(mended, new), lambda x: x != "")


def clean_page_lines(c: Column) -> Column:
    """Page-number lines dropped and runs of empty lines squeezed."""
    dropped = F.regexp_replace(c, r"(?mi)^[^\S\n]*(page[^\S\n]+)?\d+([^\S\n]+of[^\S\n]+\d+)?[^\S\n]*$\n?", "")
    return F.regexp_replace(dropped, r"\n{3,}", "\n\n")


def join_continuations(c: Column) -> Column:
    """Lines that don't begin a ``[time] Speaker:`` block joined to the line before."""
    return F.regexp_replace(c, r"\n(?!\[\d)", " ")


# what law and clerks add to the title of an agenda item (fixed values): what a motion does and through whom, in what
# relation people stand to it
MOTIONS = {"adopting": "", "authorizing": "the village manager to ", "determining": "that ", "scheduling": ""}
PRINCIPALS, AGENTS = ["applicant", "owner"], ["architect", "representative"]
DASHES = "[-—]"


def _then(c: Column, step) -> Column:
    """``step`` of a column that is bound to a variable, so that an expression with many uses of it stays small."""
    return F.transform(F.array(c), step)[0]


def _until(c: Column, mark: str) -> Column:
    """The text before the first place of a pattern."""
    return F.split(c, f"(?i){mark}", 2)[0]


def _variance(c: Column) -> Column:
    """``Request for a X variance from Village Zoning Code ...`` as ``seeking X variance``."""
    low = F.lower(c)
    asked, code = F.locate("request for ", low), F.locate(" from village zoning code", low)
    subject = F.substring(c, asked + 12, code - asked - 12)
    what = F.regexp_extract(subject, r"(?i)^(?:an? )?(.+) variances?$", 1)
    told = F.concat(F.substring(c, F.lit(1), asked - 1), F.lit("seeking "), what, F.lit(" variance"))
    return F.when((asked > 0) & (code > asked) & (what != ""), told).otherwise(c)


def _principal_last(c: Column) -> Column:
    """``Somebody, owner - what - more`` as ``what (Somebody)``."""
    mark = F.regexp_extract(c, rf"(?i),\s*(?:{'|'.join(PRINCIPALS)})s?\s*{DASHES}+\s*", 0)

    def turned(m: Column) -> Column:
        who = F.call_function("substring_index", c, m, F.lit(1))
        what = F.trim(_until(F.substring(c, F.length(who) + F.length(m) + 1, F.length(c)), DASHES))
        return F.when((m != "") & (what != ""), F.concat(what, F.lit(" ("), who, F.lit(")"))).otherwise(c)

    return _then(mark, turned)


def _without_agent(c: Column) -> Column:
    """``Somebody, architect for what`` as ``what``."""
    rest = F.ltrim(F.substring(c, F.instr(c, ",") + 1, F.length(c)))
    alone = F.substring_index(c, ",", 1).rlike(r"^[\w\s]+$") & (F.instr(c, ",") > 0)

    def cut(r: Column) -> Column:
        found = F.when(F.lit(False), F.lit(0))
        for role in AGENTS:
            found = found.when(F.lower(r).startswith(role), F.lit(len(role)))
        after = F.regexp_replace(F.ltrim(F.substring(r, found + 1, F.length(r))), r"(?i)^for\s+", "")
        return F.when(alone & found.isNotNull(), after).otherwise(c)

    return _then(rest, cut)


def _without_opening(opening: str, c: Column) -> Column:
    return F.when(F.lower(c).startswith(opening), F.substring(c, len(opening) + 1, 1 << 30)).otherwise(c)


def clean_agenda_title(c: Column, limit: int = 120) -> Column:
    """What an agenda item is about, without map references, formulas of motions and who represents whom; longer
    titles end in three dots."""
    plain = F.trim(c)
    for place in (rf"\s*{DASHES}\s*located in a ", r"\s*designated on the tax maps", r"\s*section \d+\.\d+ block \d+"):
        plain = _until(plain, place)
    for does, through in MOTIONS.items():
        opening = f"consider {does} {through}"
        plain = _then(plain, partial(_without_opening, opening))
    for step in (_variance, _principal_last, _without_agent):
        plain = _then(plain, step)
    cut = lambda t: F.concat(F.substring(t, 1, limit - 3), F.lit("..."))
    return F.trim(_then(plain, lambda t: F.when(F.length(t) > limit, cut(t)).otherwise(t)))


@F.pandas_udf(DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts by matching blocks, from 0 to 1; null if either is null."""
    from difflib import SequenceMatcher

    def one(x, y):
        return None if x is None or y is None else SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


_TOKEN = re.compile(r"[^\W\d_][\w'’-]*|\w+|\n|[^\w\s]")
#: What a sentence, a list item or a heading begins after, and what may stand between a name and words that go on with it.
_OPENS, _GOES_ON = set(".!?:-•*#\n"), set(",:;\n")


def _base(word: str) -> str:
    """``base_token`` of a word."""
    word = word.replace("’", "'")
    return (word[:-2] if word.endswith("'s") else word).split("-")[0]


def _capital(token: str, first: bool = False) -> bool:
    """Whether a token is written like a name; a first name has small letters alone after its capital."""
    if len(token) < 3 or not "A" <= token[0] <= "Z":
        return False
    return token[1:].isascii() and (token[1:].isalpha() and token[1:].islower() if first else token[1:].replace("'", "").replace("-", "").isalpha())


def people_of(whole: str, not_names: frozenset[str]) -> list[str]:
    """The pairs of capitalised words of a text that stand inside a sentence: not at its begin or that of a list item, not
    before another capitalised word, as in headings, and not with a word that is no name."""
    tokens = _TOKEN.findall(whole)
    words = [i for i, t in enumerate(tokens) if t != "\n"]
    found, k = {}, 0
    while k + 1 < len(words):
        i, j = words[k], words[k + 1]
        if not (_capital(tokens[i], True) and _capital(tokens[j])):
            k += 1
            continue
        after = j + 1
        while after < len(tokens) and tokens[after] in _GOES_ON:
            after += 1
        heads_on = after < len(tokens) and len(tokens[after]) > 1 and "A" <= tokens[after][0] <= "Z" and "a" <= tokens[after][1] <= "z"
        begins = i == 0 or tokens[i - 1] in _OPENS
        if not begins and not heads_on and not not_names & {_base(tokens[i]), _base(tokens[j])}:
            found[f"{tokens[i]} {tokens[j]}"] = None
        k += 2
    return list(found)


def people_in(c: Column, not_names: tuple[str, ...] = ()) -> Column:
    """``people_of`` each text, in order; null has none. The rules look at what is around a pair, so this is a function of texts."""
    none = frozenset(not_names)

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: people_of(t or "", none))

    return run(c)


STREET = r"\b\d{1,5} [A-Z][a-z]+(?: [A-Z][a-z]+)? (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Place|Pl|Court|Ct)\b"
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATE = rf"\b{MONTH} \d{{1,2}}, \d{{4}}\b"
MONEY = r"\$[\d,]+(?:\.\d+)?(?: (?:thousand|million|billion))?"
MOTION = r"(?i)motion (?:made )?by ([A-Z][\w.'-]+(?: [A-Z][\w.'-]+)*)"


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def short_id(c: Column) -> Column:
    """Twelve hexadecimal digits of the MD5 digest."""
    return F.substring(F.md5(c), 1, 12)


def clock(seconds: Column) -> Column:
    """Minutes and seconds."""
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def upper_ratio(c: Column) -> Column:
    """Share of upper-case letters among letters; 0 without letters."""
    upper, letters = F.length(F.regexp_replace(c, "[^A-Z]+", "")), F.length(F.regexp_replace(c, "[^A-Za-z]+", ""))
    return F.coalesce(F.try_divide(upper, letters), F.lit(0.0))


def clean_model_output(c: Column) -> Column:
    """A reply without thinking blocks and code fences, up to its last sentence."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?m)^```\w*\n?|```$", "")
    return F.trim(F.regexp_replace(plain, r"(?s)([.!?])[^.!?]*$", "$1"))


def json_array_in(c: Column) -> Column:
    """The outermost bracketed part of a text; empty if none."""
    return F.regexp_extract(c, r"(?s)\[.*\]", 0)


def search_terms(c: Column) -> Column:
    """Lower-case runs of letters and digits: how texts and queries are cut into terms."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
