"""Scalar functions on columns: normalisers, time and sample arithmetic, tokens, strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_RATE = 16_000
SPEECH_RMS = 0.01
#: Tokens that attach to the word before them.
ATTACHED = (".", ",", "!", "?", ";", ":", "%", ")", "]", "}", "'")


def nonneg(x: Column) -> Column:
    """Saturating at zero, as unsigned arithmetic is."""
    return F.greatest(x, F.lit(0))


# --- normalisers: four different rules -------------------------------------------------
def normalize_ctc(w: Column) -> Column:
    """Unicode letters and digits in lower case; single quotes kept, curly ones made straight."""
    return F.regexp_replace(F.translate(F.lower(w), "‘’", "''"), r"[^\p{L}\p{N}']", "")


def normalize_ascii(w: Column) -> Column:
    """ASCII letters, digits and the straight quote, in lower case."""
    return F.lower(F.regexp_replace(w, "[^A-Za-z0-9']", ""))


def normalize_alnum(w: Column) -> Column:
    """Unicode letters and digits in lower case, no quotes."""
    return F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")


def normalize_edges(w: Column) -> Column:
    """Anything but letters and digits trimmed at both ends; ASCII letters in lower case."""
    trimmed = F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.translate(trimmed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- samples and time ------------------------------------------------------------------
def seconds_to_samples(s: Column, least: int = 0) -> Column:
    return F.greatest(F.round(F.greatest(s, F.lit(0.0)) * SAMPLE_RATE).cast("long"), F.lit(least))


def samples_to_ms(n: Column, rate: int = SAMPLE_RATE) -> Column:
    return F.lit(0).cast("long") if rate == 0 else F.round(n / rate * 1000).cast("long")


def token_to_ms(i: Column, total: Column, duration: Column) -> Column:
    return F.least(F.round(i / total * duration).cast("long"), duration)


def frame_to_ms(frame: Column, hop: int, subsample: int, rate: int, offset: Column, duration: Column) -> Column:
    return F.least(nonneg(F.round(frame * hop * subsample * 1000.0 / rate + offset).cast("long")), duration)


def seconds_to_ms(s: Column) -> Column:
    """Rounded, within 0 and 2^32 - 1."""
    return F.least(nonneg(F.round(s * 1000).cast("long")), F.lit((1 << 32) - 1))


def interpolate_ms(start: Column, end: Column, part: Column, whole: Column) -> Column:
    """Floored linear interpolation; ``start`` where the interval or the whole is degenerate."""
    inside = start + F.call_function("div", (end - start) * part, F.nullif(whole, F.lit(0)))
    return F.when((whole == 0) | (end <= start), start).otherwise(inside)


def remap_ms(t: Column, from_start: Column, from_end: Column, to_start: Column, to_end: Column) -> Column:
    """A time of a source interval, clamped to it and scaled into a target interval."""
    inside = F.least(F.greatest(t, from_start), from_end) - from_start
    scaled = to_start + F.call_function("div", inside * (to_end - to_start), F.nullif(from_end - from_start, F.lit(0)))
    return F.when((from_end <= from_start) | (to_end <= to_start), to_start).otherwise(scaled)


def offset_ms(t: Column, offset: Column, duration: Column) -> Column:
    return F.least(nonneg(t + offset), duration)


def midpoint(start: Column, end: Column) -> Column:
    return F.call_function("div", start + end, F.lit(2))


# --- samples and logits ----------------------------------------------------------------
def rms(samples: Column) -> Column:
    """Root mean square; 0 for no samples. Sums in double."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) == 0, 0.0).otherwise(F.sqrt(total / F.size(samples)))


def preemphasis(samples: Column, k: float = 0.97) -> Column:
    return F.transform(samples, lambda x, i: F.when(i == 0, x.cast("double")).otherwise(x.cast("double") - k * F.get(samples, i - 1).cast("double")))


def argmax_first(logits: Column) -> Column:
    """Place of the first largest value; NaN is never chosen; 0 if nothing exceeds minus infinity."""
    clean = F.transform(logits, lambda x: F.when(F.isnan(x), F.lit(float("-inf")).cast("float")).otherwise(x))
    return F.greatest(F.array_position(clean, F.array_max(clean)) - 1, F.lit(0))


def argmax_last(logits: Column) -> Column:
    """Place of the last largest value."""
    return F.array_max(F.transform(logits, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))["i"]


# --- tokens and strings ----------------------------------------------------------------
def piece_text(piece: Column) -> Column:
    """Text of a token piece without its word-start mark; null for the unknown token."""
    return F.when(piece != "<unk>", F.regexp_replace(piece, "^▁+", ""))


def is_spoken(token: Column, piece: Column, blank: int) -> Column:
    """Whether a token stands for text: neither blank nor the unknown piece."""
    return (token != blank) & (piece != "<unk>")


def starts_word(piece: Column) -> Column:
    return F.startswith(piece, F.lit("▁"))


def attaches(w: Column) -> Column:
    return w.isin(*ATTACHED) | F.startswith(w, F.lit("'")) | F.startswith(w, F.lit("’"))


def join_words(ws: Column) -> Column:
    """Words with single spaces, but none before attached punctuation."""
    return F.array_join(F.transform(ws, lambda w, i: F.when((i == 0) | attaches(w), w).otherwise(F.concat(F.lit(" "), w))), "")


def ends_sentence(w: Column) -> Column:
    return w.rlike(r"[.!?]$")


def parse_bool(s: Column) -> Column:
    """true/1/yes/on and false/0/no/off in any case, trimmed; null for anything else."""
    low = F.lower(F.trim(s))
    return F.when(low.isin("true", "1", "yes", "on"), True).when(low.isin("false", "0", "no", "off"), False)


def utterance_id(n: Column) -> Column:
    return F.format_string("utt-%04d", n)


def worker_role(worker: Column) -> Column:
    """"processing", "response" or null, from parts of a worker's name; decoding comes first."""
    low = F.lower(F.trim(worker))
    return F.when(F.contains(low, F.lit("decode")), "processing").when(low.rlike("response|gpu|worker"), "response")


def is_json_request(content_type: Column) -> Column:
    low = F.lower(content_type)
    return F.coalesce(F.startswith(low, F.lit("application/json")) | F.endswith(low, F.lit("+json")), F.lit(False))


#: Parts of messages that decide a status.
BAD_REQUEST = "request body|not supported|decode|deserialize|audio bytes"
UNAVAILABLE = "no live worker capacity|no live workers available|no live decoder workers available|no live response workers available"


def error_status(message: Column, with_unavailable: bool = True) -> Column:
    """HTTP status of an error message; only the front end knows 503."""
    low = F.lower(message)
    out = F.when(low.rlike(BAD_REQUEST), 400)
    if with_unavailable:
        out = out.when(low.rlike(UNAVAILABLE), 503)
    return out.otherwise(500)


def enum_name(s: Column) -> Column:
    """Enumeration spelling: lower case, trimmed, hyphens as underscores."""
    return F.replace(F.lower(F.trim(s)), F.lit("-"), F.lit("_"))
