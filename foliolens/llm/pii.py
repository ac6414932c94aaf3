"""Personal data replaced by keyed surrogates, in DataFrame functions alone.

Entities are found by one pattern; each is replaced where it stands by a value that depends
on the key and on the entity alone, so an entity has the same surrogate wherever it occurs.
Digits of phone numbers, account and card numbers and octets of addresses go through a keyed
permutation of all values of their length (alternating rounds on two halves), which keeps
separators, length and the Luhn remainder and cannot give two entities one surrogate; account numbers keep
valid check digits, IPv6 addresses their form. Names
keep gender and script, mail addresses their form; these are drawn from a keyed hash, and a
check over all distinct names and addresses of the corpus lengthens them until no two share a
surrogate and none equals an original.

Null texts stay null; texts without entities stay as they are; repeated rows are rewritten
alike; empty tables give no rows; other columns are kept. ``n_chars``, where there is one,
follows the new text, and ``n_entities`` is set anew where the input has it. Ties cannot occur: what an entity becomes
depends on nothing but the key and itself. A very long text is rewritten in its row, in pieces between entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import stored

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа", "κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н", "κύριος"],
    "n": ["Dr", "Prof"],
}
WORD = r"\p{Lu}[\p{L}'’-]{1,30}"
#: In the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){1,8}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    # Four groups at least, so that times and ratios are none.
    "ipv6": (r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{3})(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
             r"|(?=(?:[0-9A-Fa-f]*:){3})(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"),
    "ipv4": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    # An international number has 7 to 15 digits, in groups or in one piece.
    "phone": (r"(?<![0-9+])\+(?=(?:[ .()-]{0,2}[0-9]){7,15}(?![0-9]))[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,14}(?:[ .-][0-9]{2,10}){0,5}(?![0-9])"
              r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
              r"|(?<![0-9.-])(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{4}(?! ?[0-9])"),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": (r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9A-Za-z])"
             r"|(?<![0-9A-Za-z+])[0-9]{12,19}(?![0-9A-Za-z])"),
    "name": rf"(?<![\p{{L}}])(?:{'|'.join(t for g in TITLES.values() for t in g)})\.? {WORD}(?: {WORD})?",
}
PATTERN = "|".join(PATTERNS.values())
HINT = "[0-9@]|(?:" + "|".join(t for g in TITLES.values() for t in g) + r")\.? \p{Lu}"
# Fixed letters for made-up words, and their like in two other scripts.
CONSONANTS, VOWELS = "bdfgklmnprstvzxf", "aeiouaeiouaeioua"
SCRIPTS = {"Cyrillic": ("aeioubdfgklmnprstvzx", "аеиоубдфгклмнпрствзх"), "Greek": ("aeioubdfgklmnprstvzx", "αειουβδφγκλμνπρστβζχ")}


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def digest(key: str, *parts: str) -> str:
    """SQL: 64 hex digits that depend on the key and the parts."""
    return f"sha2(concat_ws(':', {quoted(key)}, {', '.join(parts)}), 256)"


def rounds(key: str, kind: str, left: str, right: str, left_size: str, right_size: str) -> str:
    """SQL: struct(l, r), a keyed permutation of the pairs (l < left_size, r < right_size)."""
    mix = lambda of, i, size: f"pmod(CAST(conv(substring({digest(key, quoted(kind), size, f'CAST({i} AS STRING)', of)}, 1, 15), 16, 10) AS BIGINT), CAST({size} AS BIGINT))"
    return (f"aggregate(sequence(1, 8), named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT)), (s, i) -> "
            f"CASE WHEN i % 2 = 0 THEN named_struct('l', (s.l + {mix('s.r', 'i', left_size)}) % CAST({left_size} AS BIGINT), 'r', s.r) "
            f"ELSE named_struct('l', s.l, 'r', (s.r + {mix('s.l', 'i', right_size)}) % CAST({right_size} AS BIGINT)) END)")


def let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def power(n: str) -> str:
    return f"CAST(rpad('1', CAST({n} AS INT) + 1, '0') AS BIGINT)"


def permuted(key: str, kind: str, digits: str) -> str:
    """SQL: as many digits (2 to 36), by the keyed permutation of all digit strings of this length."""
    half = f"CAST(length({digits}) DIV 2 AS INT)"
    rest = f"(length({digits}) - {half})"
    pair = rounds(key, kind, f"substring({digits}, 1, {half})", f"substring({digits}, {half} + 1)", power(half), power(rest))
    return let(pair, "p", f"concat(lpad(CAST(p.l AS STRING), {half}, '0'), lpad(CAST(p.r AS STRING), {rest}, '0'))")


def luhn(digits: str) -> str:
    """SQL: the Luhn sum of a digit string, modulo 10."""
    return (f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN (length({digits}) - i) % 2 = 0 "
            f"THEN CAST(substring({digits}, i, 1) AS INT) ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), "
            f"CAST(substring({digits}, i, 1) AS INT) + 1) END) % 10")


def same_luhn(digits: str, new: str) -> str:
    """SQL: ``new`` (one digit shorter) with the last digit that gives the remainder of ``digits``."""
    return f"concat({new}, CAST(pmod({luhn(digits)} - {luhn(f'concat({new}, 0)')}, 10) AS STRING))"


def refilled(value: str, digits: str, kinds: str = "0-9") -> str:
    """SQL: ``value`` with its digits (characters of ``kinds``) replaced in order."""
    is_digit = "c >= '0' AND c <= '9'" if kinds == "0-9" else f"c RLIKE '[{kinds}]'"
    return (f"aggregate(split({value}, ''), named_struct('t', '', 'n', 0), (s, c) -> CASE WHEN {is_digit} "
            f"THEN named_struct('t', concat(s.t, substring({digits}, s.n + 1, 1)), 'n', s.n + 1) "
            f"ELSE named_struct('t', concat(s.t, c), 'n', s.n) END, s -> s.t)")


def remainder(account: str) -> str:
    """SQL: the remainder modulo 97 of an account number whose country and check digits stand behind, letters as 10 to 35."""
    return (f"aggregate(split(regexp_replace(upper({account}), '[^0-9A-Z]', ''), ''), 0, (a, c) -> CASE WHEN c = '' THEN a "
            "WHEN c <= '9' THEN (a * 10 + CAST(c AS INT)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)")


def made_up(hexes: str, syllables: int) -> str:
    """SQL: a word of so many syllables from hex digits, two for each."""
    hex_digits = quoted("0123456789abcdef")
    return (f"array_join(transform(sequence(0, {syllables - 1}), q -> concat(translate(substring({hexes}, 2 * q + 1, 1), {hex_digits}, {quoted(CONSONANTS)}), "
            f"translate(substring({hexes}, 2 * q + 2, 1), {hex_digits}, {quoted(VOWELS)}))), '')")


def styled(word: str, new: str) -> str:
    """SQL: ``new`` in the script and case of ``word``."""
    for script, (latin, own) in SCRIPTS.items():
        script_of = quoted(rf"\p{{Is{script}}}")
        new = f"CASE WHEN {word} RLIKE {script_of} THEN translate({new}, {quoted(latin)}, {quoted(own)}) ELSE {new} END"
    return f"CASE WHEN length({word}) > 1 AND upper({word}) = {word} THEN upper({new}) ELSE initcap({new}) END"


def name_surrogate(key: str, value: str, syllables: int) -> str:
    """SQL: title kept, given name by gender, family name by itself, so that families stay together."""
    gender = "CASE " + " ".join(f"WHEN w[0] IN ({', '.join(quoted(t + d) for t in TITLES[g] for d in ('', '.'))}) THEN {quoted(g)}" for g in "fm") + " ELSE 'n' END"
    end = f"CASE {gender} WHEN 'f' THEN 'ia' WHEN 'm' THEN 'or' ELSE 'en' END"
    family = let(made_up(digest(key, "'family'", "lower(element_at(w, -1))"), syllables), "y", styled("element_at(w, -1)", "y"))
    given = let(f"concat({made_up(digest(key, chr(39) + 'given' + chr(39), 'lower(w[1])', gender), max(2, syllables - 2))}, {end})", "y", styled("w[1]", "y"))
    return let(f"split({value}, ' ')", "w", f"concat_ws(' ', w[0], CASE WHEN size(w) > 2 THEN {given} END, {family})")


def mail_surrogate(key: str, value: str, syllables: int) -> str:
    """SQL: an address under the reserved domain; addresses of one domain keep one domain."""
    local = made_up(digest(key, "'local'", f"lower({value})"), 2 * syllables)
    domain = made_up(digest(key, "'domain'", f"lower(split({value}, '@')[1])"), max(2, syllables - 1))
    return f"concat({local}, '@', {domain}.example)".replace(f"{domain}.example", f"{domain}, '.example'")


def surrogate(key: str, value: str, syllables: int) -> str:
    """SQL: the surrogate of the entity ``value``."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    octets = let(f"split({value}, '[.]')", "o", let(rounds(
        key, "ipv4", "CAST(o[0] AS INT) * 256 + CAST(o[1] AS INT)", "CAST(o[2] AS INT) * 256 + CAST(o[3] AS INT)", "65536", "65536"),
        "p", "concat_ws('.', p.l DIV 256, p.l % 256, p.r DIV 256, p.r % 256)"))
    # The country code of a telephone number stays.
    kept = f"regexp_extract({value}, {quoted('^[+][0-9]{1,3}(?=[ .(-])')}, 0)"
    # The digits of an account number move behind its country and check digits, which are made valid again.
    body = let("substring(e, 5)", "b", let("regexp_replace(b, '[^0-9]', '')", "d", let(permuted(key, "iban", "d"), "n", refilled("b", "n"))))
    account = let(value, "e", let(body, "b", let(remainder("concat(b, substring(e, 1, 2), '00')"), "m",
                                                 "concat(substring(e, 1, 2), lpad(CAST(98 - m AS STRING), 2, '0'), b)")))
    hexes = let(digest(key, "'ipv6'", f"lower({value})"), "h", refilled(value, "h", "0-9A-Fa-f"))
    plain = let(kept, "k", let(f"substring({value}, length(k) + 1)", "e", let("regexp_replace(e, '[^0-9]', '')", "d", let(
        permuted(key, "digits", "d"), "n", f"concat(k, {refilled('e', 'n')})"))))
    checked = let(digits, "d", let(permuted(key, "card", "substring(d, 1, length(d) - 1)"), "h",
                                   let(same_luhn("d", "h"), "n", refilled(value, "n"))))
    is_kind = lambda kind: f"{value} RLIKE {quoted('^(?:' + PATTERNS[kind] + ')$')}"
    valid_account = f"{is_kind('iban')} AND {remainder(f'concat(substring({value}, 5), substring({value}, 1, 4))')} = 1"
    return (f"CASE WHEN instr({value}, '@') > 0 THEN {mail_surrogate(key, value, syllables)} WHEN {is_kind('ipv4')} THEN {octets} "
            f"WHEN {is_kind('ipv6')} THEN {hexes} WHEN {valid_account} THEN {account} "
            f"WHEN {is_kind('card')} THEN {checked} WHEN {value} RLIKE '[0-9]' THEN {plain} "
            f"ELSE {name_surrogate(key, value, syllables)} END")


def entities(text: str, pattern: str = PATTERN) -> str:
    """SQL: the entities of a text in order; texts without a hint are searched no further."""
    return f"CASE WHEN {text} RLIKE {quoted(HINT)} THEN regexp_extract_all({text}, {quoted(pattern)}, 0) ELSE CAST(array() AS ARRAY<STRING>) END"


def collision_free(docs: DataFrame, key: str, text_col: str = "text", syllables: int = 5) -> int:
    """The least length of made-up words at which no two names or addresses share a surrogate
    and no surrogate is an original. Distinct originals stay distributed; only counts come back.
    """
    named = f"{PATTERNS['email']}|{PATTERNS['ipv6']}|{PATTERNS['name']}"
    hint = "@|[0-9A-Fa-f]:|(?:" + "|".join(t for g in TITLES.values() for t in g) + r")\.? \p{Lu}"
    originals = stored(docs.where(F.col(text_col).rlike(hint))
                       .select(F.explode(F.expr(f"regexp_extract_all(`{text_col}`, {quoted(named)}, 0)")).alias("v"))
                       .select(F.when(F.col("v").rlike("[@:]"), F.lower("v")).otherwise(F.col("v")).alias("v")).distinct())
    while True:
        made = originals.select("v", F.expr(surrogate(key, "v", syllables)).alias("s"))
        twice = made.groupBy("s").agg(F.count_distinct(F.lower("v")).alias("n")).where("n > 1")
        taken = made.select("s").join(originals.select(F.col("v").alias("s")), "s", "left_semi")
        if not twice.take(1) and not taken.take(1):
            return syllables
        if syllables >= 12:
            raise ValueError("names or addresses still collide; take another key")
        syllables += 1


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", syllables: int | None = None) -> DataFrame:
    """``docs`` with rewritten texts, and ``n_entities``."""
    syllables = syllables or collision_free(docs, key, text_col)
    text = f"`{text_col}`"
    own = "__found"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    found = docs.withColumn(own, F.expr(entities(text)))
    gaps = f"split({text}, {quoted(PATTERN)}, -1)"
    new = (f"CASE WHEN size({own}) > 0 THEN array_join(flatten(zip_with({gaps}, "
           f"concat(transform({own}, v -> {surrogate(key, 'v', syllables)}), array('')), (g, s) -> array(g, s))), '') ELSE {text} END")
    out = found.withColumn(text_col, F.expr(new)).withColumn("n_entities", F.greatest(F.size(own), F.lit(0))).drop(own)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.char_length(text_col)).otherwise(F.col("n_chars"))
                             .cast(docs.schema["n_chars"].dataType))
    return out
