"""Text Column functions: token budget, hashing, redaction, keyword signals.

All JVM-side built-ins; nothing runs Python per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from valora import params as P

# Python str.strip() whitespace (ASCII + common Unicode spaces)
WS = "[\\s\u000b\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u001c-\u001f]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c) -> Column:
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def token_count(c) -> Column:
    """Approximate tokens: floor(chars / 4) (offline fallback tokenizer)."""
    return F.floor(F.length(_c(c)) / 4).cast("bigint")


def token_truncate(c, max_tokens: int, ellipsis: bool = True) -> Column:
    """Cut to 4 * max_tokens chars; with ellipsis keep max-3 chars + '...'."""
    c = _c(c)
    max_chars = max_tokens * 4
    cut = F.concat(F.substring(c, 1, max_chars - 3), F.lit("...")) if ellipsis else F.substring(c, 1, max_chars)
    return F.when(F.length(c) <= max_chars, c).otherwise(cut)


def prompt_hash(c) -> Column:
    """First 16 hex chars of SHA-256."""
    return F.substring(F.sha2(_c(c), 256), 1, 16)


def redact(c, patterns=P.INJECTION_PATTERNS) -> Column:
    """Replace each injection phrase (case-insensitive) with [REDACTED]."""
    out = _c(c)
    for p in patterns:
        out = F.regexp_replace(out, "(?i)" + re.escape(p), "[REDACTED]")
    return out


def redact_array(c) -> Column:
    return F.transform(_c(c), lambda x: redact(x))


def redact_map_values(c) -> Column:
    return F.transform_values(_c(c), lambda k, v: redact(v))


def redact_json(c) -> Column:
    """JSON text with every string value redacted, at any depth, in objects and
    lists; keys, numbers and the structure stay.  The text comes back in
    VARIANT's form (keys sorted, no spaces); text that is no JSON gives NULL.

    A quote inside a string is escaped, so once escaped quotes and backslashes
    stand aside (as control characters, which JSON never holds as they are), the
    pieces between quotes are by turns structure and strings; a string is a key
    if a colon follows."""
    text = F.to_json(F.try_parse_json(_c(c)))
    pieces = F.split(F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02")), '"')
    after = F.concat(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), F.array(F.lit("")))
    both = F.arrays_zip(pieces.alias("s"), after.alias("next"))
    done = F.transform(both, lambda p, i: F.when((i % 2 == 1) & ~F.startswith(p["next"], F.lit(":")), redact(p["s"])).otherwise(p["s"]))
    return F.replace(F.replace(F.array_join(done, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def redact_variant(v) -> Column:
    """A VARIANT with every string value redacted."""
    return F.try_parse_json(redact_json(F.to_json(_c(v))))


def keyword_hits(lower_text: Column, words) -> Column:
    return sum((F.contains(lower_text, F.lit(w)).cast("int") for w in words), F.lit(0))


def sentiment(c) -> Column:
    """Bullish / Bearish when one keyword count beats the other by > 2."""
    t = F.lower(_c(c))
    bull = keyword_hits(t, P.BULLISH_KEYWORDS)
    bear = keyword_hits(t, P.BEARISH_KEYWORDS)
    return (F.when(bull > bear + 2, F.lit("Bullish"))
            .when(bear > bull + 2, F.lit("Bearish")).otherwise(F.lit("Neutral")))


def risk_factors(c) -> Column:
    """Risks whose first word occurs in the text (first 3), else the default."""
    t = F.lower(_c(c))
    cand = F.array(*[F.when(F.contains(t, F.lit(r.lower().split()[0])), F.lit(r))
                     for r in P.POTENTIAL_RISKS])
    found = F.filter(cand, lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("Market uncertainty"))).otherwise(F.slice(found, 1, 3))


def key_points(chunks) -> Column:
    """From the first 2 chunks, the first 2 '.'-sentences longer than 30
    chars (stripped + '.'), at most 3 overall."""
    first2 = F.slice(_c(chunks), 1, 2)
    per_chunk = F.transform(first2, lambda ch: F.transform(
        F.filter(F.slice(F.split(ch, r"\.", -1), 1, 2), lambda s: F.length(s) > 30),
        lambda s: F.concat(strip(s), F.lit("."))))
    return F.slice(F.flatten(per_chunk), 1, 3)
