"""Two terms within N words of each other, computed inside each document row."""

from pyspark.sql import DataFrame, functions as F

from foliolens.functions.arrays import count_while, pin, running_totals, search_steps, sql_string
from foliolens.functions.patterns import WORD, WS, term_pattern
from foliolens.operators.spans import CONTEXT_CHARS, contexts, find, with_snippet_parts
from foliolens.schema import DOC_COLUMNS

_LOW = (1 << 32) - 1
PAIRS_AT_ONCE = 1024


def with_word_spans(df: DataFrame, term: str, case_sensitive: bool, out: str,
                    text: str = "text") -> DataFrame:
    """Add ``out``: matches as struct(start, end, ws, we) with word ordinals.

    ``ws`` = words that begin before the match; ``we`` = words that begin before its end,
    one less where a word runs on past the end. Then for two matches, one after the other,
    the words in the text between them are ``later.ws - earlier.we``.

    Everything is counted on the pieces between matches, so the text is gone over a fixed
    number of times, however many matches or words there are.
    """
    closes = "false" if term[-1].isspace() else "true"
    opens = "false" if term[0].isspace() else "true"
    has_ink = f"rlike(%s, r'[^{WS}]')"

    df = pin(df, find(text, term_pattern(term, case_sensitive)))
    # a leg is a piece and the match after it; the last leg is the piece after the last match
    df = pin(df, {"_legs": f"""zip_with(_pieces, _found, (piece, m) -> named_struct(
            'match_chars', char_length(m),
            'chars', char_length(piece) + char_length(m),
            'words', regexp_count(concat(piece, coalesce(m, '')), r'{WORD}'),
            'leg_opens', {has_ink % "left(if(piece = '', coalesce(m, ''), piece), 1)"},
            'piece_closes', {has_ink % "right(piece, 1)"},
            'no_piece', piece = ''))"""}, drop=("_pieces",))

    # does a word run on past the end of match i (counted from 0) into the next leg?
    runs_on = f"({closes} AND coalesce(get(_legs, %s).leg_opens, false))"
    # both running totals in one pass: characters above bit 32, words below
    df = pin(df, {"_steps": f"""transform(slice(_legs, 1, size(_found)), (g, i) ->
        shiftleft(cast(g.chars AS bigint), 32) + g.words - int(i > 0 AND {runs_on % "i"}))"""}, drop=("_found",))
    df = pin(df, {"_totals": running_totals("_steps", "bigint")}, drop=("_steps",))
    touches = f"(_legs[i].piece_closes OR (_legs[i].no_piece AND i > 0 AND {closes}))"
    df = pin(df, {out: f"""transform(
        transform(_totals, (t, i) -> named_struct(
            'end', int(shiftright(t, 32)), 'words', int(t & {_LOW}L), 'chars', _legs[i].match_chars,
            'runs_on', int({runs_on % "i + 1"}),
            'own', {len(term.split())} - int({opens} AND {touches}))),
        m -> named_struct('start', m.end - m.chars, 'end', m.end,
                          'ws', m.words - m.own, 'we', m.words - m.runs_on))"""}, drop=("_legs", "_totals"))
    return df


def with_reach(df: DataFrame, term1: str, term2: str, distance: int, out: str = "reach",
               case_sensitive: bool = False, cap: int | None = None, text: str = "text",
               drop: tuple[str, ...] = ()) -> DataFrame:
    """Add which matches of the second term each match of the first one reaches, as places.

    Three columns whose names begin with ``out``: ``ones`` (start, end, and as places in ``twos`` the ``before`` matches from ``first`` on
    that lie in front of it and the ``after`` ones from ``next`` on behind it, and ``rank``, the pairs
    of the matches before it), ``twos`` (start, end), and ``upto`` (running numbers of pairs). Both
    stretches come from binary searches, so pairs are counted without being made: a
    document of a million matches of each term takes no more memory than its matches.
    With ``cap``, no further first-term match is taken up once so many pairs were found.
    A null text gives null; keep out documents that lack a term beforehand.
    """
    if distance < 0 or (cap is not None and cap < 1):
        raise ValueError("distance must be at least 0 and cap at least 1")
    df = with_word_spans(df, term1, case_sensitive, "_one", text)
    df = with_word_spans(df, term2, case_sensitive, "_two", text)
    df = pin(df, {"_steps": search_steps("_two")})

    def place(test: str) -> str:
        return count_while("_steps", lambda i: f"get(_two, {i}).{test}")

    # words and places of the second term's matches only grow, so each stretch has two ends
    df = pin(df, {"_found": f"""transform(_one, m -> named_struct('start', m.start, 'end', m.end,
        'first', {place(f"we < m.ws - {distance}")}, 'last', {place("end < m.start")},
        'next', {place("start <= m.end")}, 'past', {place(f"ws <= m.we + {distance}")}))"""}, drop=("_one", "_steps"))
    df = pin(df, {"_each": "transform(_found, m -> greatest(m.last - m.first, 0) + cast(greatest(m.past - m.next, 0) AS bigint))"})
    df = pin(df, {"_upto": running_totals("_each", "bigint")}, drop=("_each",))
    taken = "size(_found)"
    if cap is not None:
        df = pin(df, {"_steps": search_steps("_upto")})
        taken = f"least(size(_found), 1 + {count_while('_steps', lambda i: f'get(_upto, {i}) < {cap}')})"
        drop = ("_steps", *drop)
    ones = f"""transform(slice(_found, 1, {taken}), (m, i) -> named_struct('start', m.start, 'end', m.end,
        'first', m.first, 'before', greatest(m.last - m.first, 0), 'next', m.next, 'after', greatest(m.past - m.next, 0),
        'rank', coalesce(get(_upto, i - 1), 0L)))"""
    twos = "transform(_two, o -> named_struct('start', o.start, 'end', o.end))"
    return pin(df, {f"{out}_ones": ones, f"{out}_twos": twos, f"{out}_upto": f"slice(_upto, 1, {taken})"},
               drop=("_found", "_two", "_upto", *drop))


def reach_columns(reach: str) -> tuple[str, ...]:
    return tuple(f"{reach}_{part}" for part in ("ones", "twos", "upto"))


def reach_count(reach: str) -> str:
    """SQL text: the number of pairs, as a bigint; null for a null text."""
    return f"if({reach}_upto IS NULL, null, coalesce(get({reach}_upto, size({reach}_upto) - 1), 0L))"


_PAIR = "o -> named_struct('start', least(m.start, o.start), 'end', greatest(m.end, o.end))"


def reach_pairs(reach: str, most: int | None = None) -> str:
    """SQL text: struct(start, end) of all pairs, or the first ``most``, in order of the first term."""
    if most is None:
        reached = f"concat(slice({reach}_twos, m.first + 1, m.before), slice({reach}_twos, m.next + 1, m.after))"
        return f"flatten(transform({reach}_ones, m -> transform({reached}, {_PAIR})))"
    reached = (f"concat(slice({reach}_twos, m.first + 1, least(m.before, {most})),"
               f" slice({reach}_twos, m.next + 1, least(m.after, {most})))")
    needed = f"filter({reach}_ones, m -> m.rank < {most} AND m.before + m.after > 0)"
    return f"slice(flatten(transform({needed}, m -> transform({reached}, {_PAIR}))), 1, {most})"


def _block_pairs(reach: str, block: str, size: int) -> str:
    """SQL text: the pairs numbered ``block * size`` and following, at most ``size``."""
    low, high = f"{block} * {size}", f"({block} + 1) * {size}"
    at = count_while("_steps", lambda i: f"get({reach}_upto, {i}) <= {low}")
    end = count_while("_steps", lambda i: f"get({reach}_upto, {i}) < {high}")
    skip = f"int(greatest({low} - m.rank, 0))"
    upto = f"int(least({high} - m.rank, m.before + cast(m.after AS bigint)))"
    reached = (f"concat(slice({reach}_twos, m.first + {skip} + 1, greatest(least({upto}, m.before) - {skip}, 0)),"
               f" slice({reach}_twos, m.next + greatest({skip} - m.before, 0) + 1, greatest({upto} - greatest({skip}, m.before), 0)))")
    return f"flatten(transform(slice({reach}_ones, {at} + 1, {end} - {at} + 1), m -> transform({reached}, {_PAIR})))"


def with_pairs(df: DataFrame, term1: str, term2: str, distance: int, out: str = "pairs",
               case_sensitive: bool = False, cap: int | None = None, text: str = "text",
               drop: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Add ``out``: struct(start, end) of every accepted pair or of the first ``most``, in order of
    the first term."""
    df = with_reach(df, term1, term2, distance, "_reach", case_sensitive, cap, text, drop)
    return pin(df, {out: reach_pairs("_reach", most)}, drop=reach_columns("_reach"))


def has_both(term1: str, term2: str, case_sensitive: bool = False) -> str:
    """Condition, as SQL text: the text has both terms."""
    return " AND ".join(f"rlike(text, {sql_string(term_pattern(t, case_sensitive))})" for t in (term1, term2))


def having_both(corpus: DataFrame, term1: str, term2: str, case_sensitive: bool = False) -> DataFrame:
    return corpus.filter(has_both(term1, term2, case_sensitive))


def pair_label(term1: str, term2: str) -> str:
    """What a pair shows as its matched text."""
    return f"{term1}...{term2}"


def _reached(corpus: DataFrame, term1: str, term2: str, distance: int, case_sensitive: bool, cap: int | None) -> DataFrame:
    """Documents with pairs: the columns of ``_reach``, and ``match_count``."""
    found = with_reach(having_both(corpus, term1, term2, case_sensitive), term1, term2, distance, "_reach", case_sensitive, cap)
    return pin(found, {"match_count": reach_count("_reach")}).filter("match_count > 0")


def search_near(corpus: DataFrame, term1: str, term2: str, distance: int,
                case_sensitive: bool = False, context_chars: int = CONTEXT_CHARS,
                cap: int | None = None, max_contexts: int | None = None) -> DataFrame:
    """Documents where both terms occur with at most ``distance`` words between, either order.

    The list of contexts holds all pairs of a document or the first ``max_contexts``;
    ``search_near_matches`` is the form for any number of pairs.
    """
    found = pin(_reached(corpus, term1, term2, distance, case_sensitive, cap),
                {"pairs": reach_pairs("_reach", max_contexts)}, drop=reach_columns("_reach"))
    return with_snippet_parts(found).select(
        *DOC_COLUMNS, "match_count", contexts("pairs", context_chars, None, pair_label(term1, term2)).alias("contexts"))


def search_near_matches(corpus: DataFrame, term1: str, term2: str, distance: int,
                        case_sensitive: bool = False, context_chars: int = CONTEXT_CHARS,
                        cap: int | None = None) -> DataFrame:
    """One row per pair, with the ``match_count`` of its document: ``PAIRS_AT_ONCE`` pairs exist at a time."""
    found = with_snippet_parts(_reached(corpus, term1, term2, distance, case_sensitive, cap))
    found = pin(found, {"_steps": search_steps("_reach_upto")})
    found = found.select("*", F.expr(f"explode(sequence(0L, (match_count - 1) div {PAIRS_AT_ONCE}))").alias("_block"))
    found = pin(found, {"some": _block_pairs("_reach", "_block", PAIRS_AT_ONCE)}, drop=("_steps", "_block", *reach_columns("_reach")))
    found = found.select(*DOC_COLUMNS, "match_count",
                         contexts("some", context_chars, None, pair_label(term1, term2)).alias("contexts"))
    return found.select(*DOC_COLUMNS, "match_count", F.inline("contexts"))


def count_near(corpus: DataFrame, term1: str, term2: str, distance: int,
               case_sensitive: bool = False, cap: int | None = None) -> DataFrame:
    """``search_near`` without contexts: pairs are counted, not made."""
    return _reached(corpus, term1, term2, distance, case_sensitive, cap).select(*DOC_COLUMNS, "match_count")
