"""Regular expressions shared by the search and text functions."""

# The white space that separates words, one class for Java patterns.
# Plain \s leaves out NBSP, U+0085, U+3000 and the U+001C..U+001F separators.
WS = r"\s\x1c-\x1f\x85\p{Z}"
WORD = f"[^{WS}]+"
WORD_CHAR = r"[\p{L}\p{N}_]"


def escape_literal(term: str) -> str:
    r"""Quote a term for a Java pattern; a ``\E`` inside it closes and reopens the quote."""
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def _whole_word(term: str, body: str) -> str:
    """Ask for a boundary on both sides, looking only where the term itself was found.

    Next to a word character of the term a boundary means no word character, next to any
    other character it means one.
    """
    def is_word(ch: str) -> bool:
        return ch.isalnum() or ch == "_"

    before = "(?<!" if is_word(term[0]) else "(?<="
    after = "(?!" if is_word(term[-1]) else "(?="
    return f"{body}{before}{WORD_CHAR}{body}){after}{WORD_CHAR})"


def term_pattern(term: str, case_sensitive: bool = False, whole_word: bool = False) -> str:
    """Pattern of a literal term, Unicode case folding unless ``case_sensitive``.

    Whole word means a change between word and non-word character on both sides,
    so a term that starts with a symbol needs a word character before it.
    """
    if not term:
        raise ValueError("a search term must not be empty")
    body = escape_literal(term)
    if whole_word:
        body = _whole_word(term, body)
    return body if case_sensitive else "(?iu)" + body


def clause_pattern(term: str, case_sensitive: bool = False, whole_word: bool = False, regex: bool = False) -> str:
    """Pattern of a term of a clause under the switches of a whole search."""
    if not regex:
        return term_pattern(term, case_sensitive, whole_word)
    if whole_word:
        raise ValueError("whole_word is for literal terms; write the boundaries into the pattern")
    return regex_pattern(term, case_sensitive)


def regex_pattern(pattern: str, case_sensitive: bool = False) -> str:
    """A user's own pattern (Java syntax). A text in which it matches the empty string is refused
    when its matches are located."""
    if not pattern:
        raise ValueError("a pattern must not be empty")
    return pattern if case_sensitive else "(?iu)" + pattern
