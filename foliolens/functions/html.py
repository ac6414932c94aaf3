"""Markup cut from left to right into comments, scripts, tags and text, and what tags say.

Everything is array functions inside the page's row. A comment or a script ends a match before
anything in it can be taken for a tag, quotes count where a value may begin, and attributes are read in turn.
The functions give SQL text, as those of ``arrays`` do.
"""

from foliolens.functions.arrays import sql_string

# Inside a tag a quoted value follows an equals sign; possessive, so that long tags cost no backtracking.
_IN_TAG = r"""(?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*+>"""
_TOKEN = "(?is)" + "|".join([
    r"<!--.*?(?:-->|\z)",
    rf"<(script|style)(?=[\s/>]){_IN_TAG}.*?(?:</\1\s*>|\z)",
    rf"<[a-z/!?]{_IN_TAG}",
    "[^<]++|<",
])
_ATTRIBUTE = r"""[^\s=>/"'<][^\s=>/]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?"""

# Character references that links hold, the ampersand last.
ENTITIES = {"&quot;": '"', "&#39;": "'", "&#34;": '"', "&lt;": "<", "&gt;": ">", "&#38;": "&", "&amp;": "&"}


def tokens(html: str) -> str:
    """Comments, scripts and styles with what they hold, tags, and pieces of text, in order."""
    return f"regexp_extract_all({html}, {sql_string(_TOKEN)}, 0)"


def is_tag(token: str, name: str) -> str:
    """Is the token a tag of this name (``/name`` for the closing one)?"""
    return f"rlike({token}, r'(?i)^<{name}[\\s/>]')"


def is_text(token: str) -> str:
    return f"({token} = '<' OR left({token}, 1) <> '<')"


def decoded(value: str) -> str:
    for code, char in ENTITIES.items():
        value = f"replace({value}, {sql_string(code)}, {sql_string(char)})"
    return value


def attribute(tag: str, name: str) -> str:
    """The value of a tag's first attribute of this name, decoded; '' without a value, null if there is none."""
    found = (f"get(filter(regexp_extract_all(regexp_replace({tag}, r'^<[^\\s/>]+', ''), {sql_string(_ATTRIBUTE)}, 0),"
             f" a -> lower(regexp_extract(a, r'^[^\\s=]+', 0)) = '{name}'), 0)")
    bare = f"regexp_replace(regexp_extract({found}, r'(?s)=\\s*(.*)$', 1), {sql_string(chr(40) + '?s)^([' + chr(34) + chr(39) + '])(.*)' + chr(92) + '1$')}, '$2')"
    return decoded(bare)


def hrefs(html: str) -> str:
    """The href values of the anchors, in order."""
    values = f"transform(filter({tokens(html)}, t -> {is_tag('t', 'a')}), t -> {attribute('t', 'href')})"
    return f"filter({values}, h -> h IS NOT NULL)"


def anchors(tokens_column: str, bounds_column: str) -> str:
    """struct(at, href, label) of the anchors: the label is the text up to the end of the anchor or the next one."""
    until = f"coalesce(get({bounds_column}, j + 1).at, size({tokens_column}))"
    label = f"array_join(filter(slice({tokens_column}, b.at + 2, {until} - b.at - 1), t -> {is_text('t')}), '')"
    each = f"named_struct('at', b.at, 'href', {attribute(f'get({tokens_column}, b.at)', 'href')}, 'label', {label})"
    return f"filter(transform({bounds_column}, (b, j) -> if(b.opens, {each}, null)), a -> a IS NOT NULL)"


def bounds(tokens_column: str, name: str) -> str:
    """struct(at, opens) of the opening and closing tags of a name."""
    marked = (f"transform({tokens_column}, (t, i) -> named_struct('at', i, 'opens', {is_tag('t', name)}, 'closes', {is_tag('t', '/' + name)}))")
    return f"transform(filter({marked}, b -> b.opens OR b.closes), b -> named_struct('at', b.at, 'opens', b.opens))"


def regions(tokens_column: str, bounds_column: str, name: str, value: str) -> str:
    """struct(start, end) of the elements with an attribute of this value, nested ones counted: places of tokens."""
    inside = f"aggregate(slice({bounds_column}, j + 1, k - j + 1), 0, (n, x) -> n + if(x.opens, 1, -1))"
    closing = f"get(filter(sequence(j, size({bounds_column}) - 1), k -> {inside} <= 0), 0)"
    end = f"coalesce(get({bounds_column}, {closing}).at, size({tokens_column}))"
    wanted = f"b.opens AND coalesce({attribute(f'get({tokens_column}, b.at)', name)} = {sql_string(value)}, false)"
    return (f"filter(transform({bounds_column}, (b, j) -> if({wanted}, named_struct('start', b.at, 'end', {end}), null)), r -> r IS NOT NULL)")
