"""DuckDB's SQL for whole matches: dynamic programming over lists, and the alignments walked back step by step. It shares
nothing with the kernel but the definition."""

from __future__ import annotations

import math

from .functions.alphabets import IUPAC_CODES, complement


def equal_to(char: str, alphabet: str) -> str:
    """The characters that equal a pattern's character."""
    if alphabet == "iupac":
        bits = IUPAC_CODES.get(char.upper(), 0)
        return "".join(x + x.lower() for x, y in IUPAC_CODES.items() if bits & y)
    return char + char.swapcase() if alphabet == "dna" and char in "ACGTacgt" else char


def _list(items: list) -> str:
    return "[" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in items) + "]"


def characters(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN []::VARCHAR[] ELSE string_split({text}, '') END"


def utf8(text: str) -> str:
    """The bytes of a text, as two hex digits each."""
    return f"regexp_extract_all(hex({text}), '..')"


#: Whether what the pattern's list holds for a place admits a character.
ADMITS, SAME = "contains({p}, {c})", "{p} = {c}"


def ends_sql(source: str, k: int, equal: str = ADMITS, alpha: float | None = None, longest: int = 64) -> str:
    """doc_id, n, e, c: all ends with at most k edits, end 0 included. source: doc_id, chars and p (what each place of the
    pattern admits). Values above k need not be exact, so a row looks at k columns to the left only."""
    step = (lambda j: f"list_extract({_list([math.floor(alpha * i) for i in range(longest + 1)])}, CAST({j} AS BIGINT) + 1)") if alpha is not None else (lambda j: j)
    pad = " || list_transform(range(0, len(p)), lambda x: '*')" if alpha is not None else ""
    left = ", ".join(f"CASE WHEN i >= {d} THEN cand[i + 1 - {d}] + {d} END" for d in range(1, k + 1))
    same = equal.format(p="p[j + 1]", c="chars[i]")
    return f"""SELECT doc_id, n, e, c + {step('greatest(e - n, 0)')} AS c FROM (
        WITH RECURSIVE dp AS (
            SELECT doc_id, p, len(chars) AS n, chars{pad} AS chars, 0 AS j, list_transform(range(0, len(chars{pad}) + 1), lambda x: 0) AS r FROM ({source})
            UNION ALL
            SELECT doc_id, p, n, chars, j + 1, list_transform(range(0, len(cand)), lambda i: least(cand[i + 1]{', ' + left if left else ''})) FROM (
                SELECT doc_id, p, n, chars, j, list_transform(range(0, len(chars) + 1), lambda i: CASE WHEN i = 0 THEN CAST({step('j + 1')} AS INTEGER) ELSE least(r[i] + CASE WHEN {same} THEN 0 ELSE 1 END, r[i + 1] + 1) END) AS cand
                FROM dp WHERE j < len(p)))
        SELECT doc_id, n, unnest(range(0, len(r))) AS e, unnest(r) AS c FROM dp WHERE j = len(p)) WHERE c + {step('greatest(e - n, 0)')} <= {k}"""  # fmt: skip


def aligned_sql(source: str, ends: str, k: int, equal: str = ADMITS, alpha: float | None = None, longest: int = 64) -> str:
    """doc_id, n, e, c, text_start, text_end, pattern_start, pattern_end, ops and cigar of ends (doc_id, n, e, c): from the
    end back, of the steps that keep the cost least, the first of match, text character alone, substitution, pattern
    character alone."""
    steps = _list([math.floor(alpha * i) for i in range(longest + 1)]) if alpha is not None else None
    first = f"CAST({steps}[j + 2] AS INTEGER)" if steps else "j + 1"
    edge = "AND walk.i > 0" if alpha is not None else ""
    same = lambda j, c: equal.format(p=f"p[{j}]", c=c)
    return f"""(WITH RECURSIVE m AS (
            SELECT row_number() OVER () AS rid, x.doc_id, x.n, x.e, x.c, y.p, least(x.e, x.n) AS stop, greatest(0, least(x.e, x.n) - len(y.p) - {k}) AS lead,
                y.chars[greatest(0, least(x.e, x.n) - len(y.p) - {k}) + 1:least(x.e, x.n)] AS w FROM ({ends}) x JOIN ({source}) y USING (doc_id)),
        al AS (
            SELECT rid, p, w, 0 AS j, [list_transform(range(0, len(w) + 1), lambda x: 0)] AS t FROM m
            UNION ALL
            SELECT rid, p, w, j + 1, list_append(t, list_transform(range(0, len(w) + 1), lambda i: list_min(list_transform(range(0, i + 1), lambda b: CAST(cand[b + 1] + i - b AS INTEGER))))) FROM (
                SELECT rid, p, w, j, t, list_transform(range(0, len(w) + 1), lambda i: CASE WHEN i = 0 THEN {first} ELSE least(t[j + 1][i] + CASE WHEN {same('j + 1', 'w[i]')} THEN 0 ELSE 1 END, t[j + 1][i + 1] + 1) END) AS cand FROM al WHERE j < len(p))),
        done AS (SELECT rid, p, w, t FROM al WHERE j = len(p)),
        walk AS (
            SELECT rid, len(w) AS i, len(p) - greatest(e - n, 0) AS j, '' AS ops FROM m
            UNION ALL
            SELECT rid, i - CASE WHEN op = 'D' THEN 0 ELSE 1 END, j - CASE WHEN op = 'I' THEN 0 ELSE 1 END, op || ops FROM (
                SELECT walk.rid, walk.i, walk.j, walk.ops, CASE
                    WHEN walk.i > 0 AND t[walk.j + 1][walk.i + 1] = t[walk.j][walk.i] AND {same('walk.j', 'w[walk.i]')} THEN '='
                    WHEN walk.i > 0 AND t[walk.j + 1][walk.i + 1] = t[walk.j + 1][walk.i] + 1 THEN 'I'
                    WHEN walk.i > 0 AND t[walk.j + 1][walk.i + 1] = t[walk.j][walk.i] + 1 THEN 'X' ELSE 'D' END AS op
                FROM walk JOIN done USING (rid) WHERE walk.j > 0 {edge}))
        SELECT doc_id, n, e, CAST(c AS INTEGER) AS c, CAST(lead + i AS BIGINT) AS text_start, CAST(stop AS BIGINT) AS text_end, CAST(j AS INTEGER) AS pattern_start, CAST(len(p) - greatest(e - n, 0) AS INTEGER) AS pattern_end, ops,
            array_to_string(list_transform(regexp_extract_all(ops, '=+|I+|X+|D+'), lambda x: CASE WHEN length(x) > 1 THEN CAST(length(x) AS VARCHAR) ELSE '' END || left(x, 1)), '') AS cigar
        FROM walk JOIN m USING (rid) WHERE j = 0 {'OR i = 0' if alpha is not None else ''})"""  # fmt: skip


def source_sql(pattern: str, text: str, alphabet: str, table: str = "documents", key: str = "doc_id", alpha: float | None = None) -> str:
    """doc_id, chars and p of one pattern in the texts of a table."""
    admits = [equal_to(c, alphabet) for c in pattern]
    return f"SELECT {key} AS doc_id, {characters('s')} AS chars, {_list([x + '*' if alpha is not None and x else x for x in admits])} AS p FROM (SELECT {key}, {text} AS s FROM {table})"


def rows_sql(pattern: str, k: int, text: str, alphabet: str, pick, rc: bool = False, alpha: float | None = None, keep: str = "true") -> str:
    """doc_id, strand, cost, text_start, text_end, pattern_start, pattern_end, match_region, cigar and ops of the ends that
    pick (SQL of ends to SQL of ends) selects, on + and, if asked for, on the reversed text with the complement. keep: a
    condition on s (the strand's text), e and n."""
    made = []
    for strand in "+-" if rc else "+":
        needle = pattern if strand == "+" else complement(pattern.encode(), alphabet).decode()
        own = text if strand == "+" else f"reverse({text})"
        source = source_sql(needle, own, alphabet, alpha=alpha)
        ends = pick(ends_sql(source, k, alpha=alpha))
        if keep != "true":
            ends = f"SELECT x.* FROM ({ends}) x JOIN (SELECT doc_id, {own} AS s FROM documents) USING (doc_id) WHERE {keep.format(pattern=needle)}"
        shown = "substring(s, text_start + 1, text_end - text_start)"
        if strand == "-":
            shown = f"translate({shown}, 'ACGTacgt', 'TGCAtgca')"
        place = "text_start, text_end" if strand == "+" else "n - text_end AS text_start, n - text_start AS text_end"
        made.append(f"SELECT doc_id, '{strand}' AS strand, c AS cost, {place}, pattern_start, pattern_end, {shown} AS match_region, cigar, ops FROM {aligned_sql(source, ends, k, alpha=alpha)} JOIN (SELECT doc_id, {own} AS s FROM documents) USING (doc_id)")
    return " UNION ALL ".join(made)
