"""Names: canonical keys, tokens, episode numbers, output names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a label that say how a line is heard, not who speaks.
NOISE_WORDS = ("on screen", "off screen", "voice over", "v.o", "o.s", "narration")

# Words that only tracks carry; words for parts rather than names, and those that voice lists add.
AFFIXES = ("stomach", "inc", "kaijin", "monster", "voice", "vo", "dub", "stem", "track", "ch", "channel", "16k", "src", "onscreen", "screen")
ROLE_WORDS = ("actor", "actress", "acter", "man", "woman", "boy", "girl", "agent", "narrator", "narration", "guard", "soldier", "male", "female", "crowd")
VOICE_WORDS = ("customer", "lady", "kid", "child", "team", "guy", "random", "granute", "waitress", "store", "shopkeeper")
# Languages and how voice names spell them.
VOICE_LANGUAGES = {"hi": ("hi", "hindi"), "ta": ("ta", "tamil"), "te": ("te", "telugu"), "ml": ("ml", "malayalam"), "mr": ("mr", "marathi"), "bn": ("bn", "bengali"), "kn": ("kn", "kannada")}


def canonical_key(name: Column) -> Column:
    """Lower-case letters and digits, other runs as one underscore."""
    return F.replace(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), F.lit(" "), F.lit("_"))


def untagged(raw: Column) -> Column:
    """A label without what stands in brackets or parentheses."""
    return F.regexp_replace(raw, r"\[[^\]]*\]|\([^)]*\)", " ")


def speakers(raw: Column) -> Column:
    """Distinct canonical keys of a label that may name several speakers, in order."""
    c = untagged(F.lower(raw))
    for w in NOISE_WORDS:
        c = F.replace(c, F.lit(w), F.lit(" "))
    return F.array_distinct(F.filter(F.transform(F.split(c, "[/&+]"), canonical_key), lambda k: k != ""))


def squash(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t != "")


def generic(name: Column, words: tuple[str, ...] = ROLE_WORDS) -> Column:
    """Whether a name says what someone is, not who: it has words, and each is one of ``words``, short or a number."""
    t = tokens(name)
    return (F.size(t) > 0) & F.forall(t, lambda x: x.isin(*words) | (F.length(x) <= 2) | x.rlike("^[0-9]+$"))


def shares_word(a: Column, b: Column, least: int = 3) -> Column:
    """Whether two names have a word of ``least`` characters or more in common."""
    long = lambda c: F.filter(tokens(F.coalesce(c, F.lit(""))), lambda x: F.length(x) >= least)
    return F.arrays_overlap(long(a), long(b))


# Words that stand before an episode's number; folders also cut the longest one short.
EPISODE_WORDS, CUT_WORD = ("EP", "EPI", "EPISODE"), "EPISOD"


def _parts(name: Column) -> Column:
    """A name as its runs of digits and what stands between them, all white space as blanks."""
    return F.regexp_extract_all(F.regexp_replace(name, r"\s", " "), F.lit("[0-9]+|[^0-9]+"), F.lit(0))


def _first_number(name: Column, rule: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """The first number of a name for which ``rule`` holds of it, its index, what stands before it and after it; null without."""
    parts = _parts(name)
    held = F.filter(parts, lambda x, i: F.substring(x, 1, 1).between("0", "9") & rule(x, i, F.coalesce(F.get(parts, i - 1), F.lit("")), F.coalesce(F.get(parts, i + 1), F.lit(""))))
    return F.try_element_at(held, F.lit(1)).try_cast("int")


def _bare(before: Column) -> Column:
    """What stands before a number, upper-cased, less one hyphen or underscore and the blanks around it."""
    cut = F.rtrim(F.upper(before))
    return F.rtrim(F.when(F.substring(cut, -1, 1).isin("-", "_"), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut))


def _last_word(before: Column, letters: str = "A-Z") -> Column:
    return F.regexp_extract(_bare(before), f"[{letters}]*$", 0)


def folder_episode(name: Column) -> Column:
    """The number after a word that ends in ``EP``, ``EPI``, ``EPISOD`` or ``EPISODE``."""
    return _first_number(name, lambda x, i, before, after: _ends_in(_last_word(before), *EPISODE_WORDS, CUT_WORD))


def _ends_in(word: Column, *ends: str) -> Column:
    return reduce(or_, (F.endswith(word, F.lit(e)) for e in ends))


def episode_number(name: Column) -> Column:
    """The number right after ``#``, else after the word ``EP``, ``EPI`` or ``EPISODE``, else right after a capital ``E`` on its own; or null."""
    marked = _first_number(name, lambda x, i, before, after: F.endswith(before, F.lit("#")))
    worded = _first_number(name, lambda x, i, before, after: _last_word(before).isin(*EPISODE_WORDS))
    # a part that is all E behind a number belongs to it
    short = _first_number(name, lambda x, i, before, after: (F.regexp_extract(before, "[A-Za-z]*$", 0) == "E") & ~((before == "E") & (i >= 2)))
    return F.coalesce(marked, worded, short)


def watched_episode(path: Column) -> Column:
    """The number after ``#``, of which three digits count, else one of three digits at most after ``EP``, ``EPI`` or ``EPISODE``, both words of their own."""
    marked = F.filter(_parts(path), lambda x, i: F.substring(x, 1, 1).between("0", "9") & F.endswith(F.rtrim(F.coalesce(F.get(_parts(path), i - 1), F.lit(""))), F.lit("#")))
    alone = lambda after: ~F.substring(after, 1, 1).rlike("[A-Za-z_]")
    # nothing but the word between two numbers makes one word of all
    worded = _first_number(path, lambda x, i, before, after: _last_word(before, "A-Z_").isin(*EPISODE_WORDS) & ~((i >= 2) & _bare(before).isin(*EPISODE_WORDS)) & (F.length(x) <= 3) & alone(after))
    return F.coalesce(F.substring(F.try_element_at(marked, F.lit(1)), 1, 3).try_cast("int"), worded)


def path_episode(url: Column) -> Column:
    """The number, of four digits at most behind its zeros, that begins the part of a path after one of two letters; the first such part counts, longer numbers do not."""
    # DuckDB makes the dotted capital one letter, ICU two
    low = F.lower(F.replace(url, F.lit("İ"), F.lit("i")))
    return F.regexp_extract(low, "/[a-z]{2}/0*([0-9]{1,4})(?:[^0-9]|$)", 1).try_cast("int")


def names_episode(name: Column, number: Column) -> Column:
    """Whether a name holds the number on its own, zeros before it allowed."""
    held = F.regexp_extract_all(name, F.lit("[0-9]+"), F.lit(0))
    return F.exists(held, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "") == number.cast("string"))


def episode_range(name: Column) -> Column:
    """first and last episode of a folder of several, ``41 to 45`` or ``41-45``; null without."""
    parts = _parts(name)
    joins = lambda x: F.trim(x).isin("to", "-", "–", "—")
    spans = F.filter(F.transform(parts, lambda x, i: F.when(joins(x) & (i > 0), F.struct(F.get(parts, i - 1).try_cast("int").alias("first"), F.get(parts, i + 1).try_cast("int").alias("last")))), lambda x: x["first"].isNotNull() & x["last"].isNotNull())
    return F.try_element_at(spans, F.lit(1))


def voice_languages(name: Column) -> Column:
    """Languages of a voice's name: both of ``Hindi/Tamil``, else that of the last word that names one, else ``?``."""
    words = F.filter(F.split(F.lower(name), "[^a-z]+"), lambda w: w != "")
    code = lambda w: F.coalesce(*(F.when(w.isin(*spelled), lang) for lang, spelled in VOICE_LANGUAGES.items()))
    known = F.filter(F.transform(words, code), lambda x: x.isNotNull())
    return F.when(F.lower(name).rlike(r"hindi\s*/\s*tamil"), F.array(F.lit("hi"), F.lit("ta"))).otherwise(F.array(F.coalesce(F.try_element_at(known, F.lit(-1)), F.lit("?"))))


def slug(name: Column) -> Column:
    """Words with hyphens between: short upper-case ones stay, others get a capital."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), "[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when((w == F.upper(w)) & (F.length(w) <= 4), w).otherwise(F.initcap(w))), "-")


def output_name(series: Column, episode: Column, what: str, day: Column) -> Column:
    """``Series_EP07_What_2024-01-31``; an episode that is no number is written as a word, an empty series left out."""
    number = F.when(episode.rlike("^[0-9]+$"), F.concat(F.lit("EP"), F.lpad(episode.cast("int").cast("string"), F.greatest(F.lit(2), F.length(episode.cast("int").cast("string"))), F.lit("0")))).otherwise(slug(episode))
    parts = F.filter(F.array(slug(series), number, F.lit(what), F.date_format(day, "yyyy-MM-dd")), lambda x: x != "")
    return F.array_join(parts, "_")


# What a whole message may be, and words and phrases that it may hold, by intent.
WHOLE = {
    "help": ("?", "command", "commands", "help", "usage", "what can you do", "what can you do?"),
    "history": ("history", "my runs", "recent", "recent runs", "runs"),
}
HOLDS = {
    "asks": ("done", "finish", "finished", "is it", "progress", "ready", "result", "status"),
    "watches": ("anything new", "new file", "new files", "scan", "upload", "uploads", "watch", "whats new"),
    "sounds": ("audio", "mix", "mixes", "no script", "noscript", "scriptless"),
    "views": ("availability", "available", "check", "delivered", "file", "files", "present", "qc"),
    "starts": ("compare", "go", "kick", "launch", "run", "start"),
    "agrees": ("do it", "go", "kick", "launch", "proceed", "run", "start", "yes"),
    "acts": ("check", "run", "start"),
}


def command(text: Column) -> Column:
    """What a message asks for: help, history, status, scan, audio_check, audio_run, run or check, the first that applies; else null.

    Help and history are whole messages. Of the rest, a question for a state comes before a look at what is new, that
    before anything about sound, and a bare consent before a bare episode.
    """
    said = F.lower(F.trim(text))
    words = F.array_join(F.filter(F.split(F.replace(said, F.lit("'"), F.lit("")), "[^a-z0-9_]+"), lambda w: w != ""), " ")
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    holds = {k: reduce(or_, (F.contains(padded, F.lit(f" {p} ")) for p in phrases)) for k, phrases in HOLDS.items()}
    short = F.exists(F.split(words, " "), lambda w: w.try_cast("int").isNotNull() & (F.length(w) <= 3))
    cases = [
        ("help", said.isin(*WHOLE["help"])),
        ("history", said.isin(*WHOLE["history"])),
        ("status", holds["asks"] & ~holds["acts"]),
        ("scan", holds["watches"]),
        ("audio_check", holds["sounds"] & holds["views"] & ~holds["starts"]),
        ("audio_run", holds["sounds"] & holds["starts"]),
        ("run", holds["agrees"]),
        ("check", short | folder_episode(text).isNotNull()),
    ]
    return F.coalesce(*(F.when(applies, intent) for intent, applies in cases))


def common_prefix(low: Column, high: Column) -> Column:
    """The common prefix of the least and greatest of a set of names, which is that of all."""
    n = F.least(F.length(low), F.length(high))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i))
    return F.substring(low, F.lit(1), F.array_max(same))


def cut_prefix(prefix: Column) -> Column:
    """A prefix cut back to behind the first listed separator that it has, else nothing."""
    out = F.lit("")
    for sep in reversed((" - ", "–", "—", "_", " ")):
        head = F.substring_index(prefix, sep, -1)
        out = F.when(F.contains(prefix, F.lit(sep)), F.substring(prefix, F.lit(1), F.length(prefix) - F.length(head))).otherwise(out)
    return out
