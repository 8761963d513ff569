"""SQL spellings of text rules for an engine without Unicode classes and back-references."""

from __future__ import annotations

WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WORD = r"[^\pL\pM\pN\p{Pc}]"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def CLEAN_TEXT(x: str) -> str:  # noqa: N802
    s = f"regexp_replace({x}, '(?s)\\[\\*\\*.*?\\*\\*\\]', ' ', 'g')"
    s = f"regexp_replace({s}, '<[^>]+>', ' ', 'g')"
    for label in ("Admission Date", "Discharge Date"):
        s = f"regexp_replace({s}, '(?i){label}:{WS}*[^\\n]*', ' ', 'g')"
    for ch in (r"\.", r"\?", "!", ",", ";", ":", r"\-"):
        s = f"regexp_replace({s}, '{ch}{{2,}}', '{ch[-1]}', 'g')"
    s = squeeze(s)
    return f"(CASE WHEN length({s}) <= 2 THEN '' ELSE {s} END)"


def boundary(pattern: str) -> str:
    r"""``\b`` at the ends of alternatives as explicit Unicode neighbours; ``\s`` and ``\w`` spelled out."""
    out, depth, alt = [], 0, ""
    for ch in pattern:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            out.append(alt)
            alt = ""
        else:
            alt += ch
    out.append(alt)

    def one(a: str) -> str:
        head = tail = ""
        if a.startswith(r"\b"):
            head, a = f"(?:^|{NOT_WORD})", a[2:]
        if a.endswith(r"\b"):
            tail, a = f"(?:$|{NOT_WORD})", a[:-2]
        a = a.replace(r"\s", WS).replace(r"\w", r"[\pL\pM\pN\p{Pc}]").replace(r"\d", r"\p{Nd}")
        return head + a + tail

    return "|".join(one(a) for a in out)


def MASK(x: str) -> str:  # noqa: N802
    """Lower-cased text of the same length whose foreign letters are plain, so ASCII word edges equal Unicode ones."""
    s = f"regexp_replace(lower({x}), '[\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g')"
    for cls in (r"\PL", r"\PM", r"\PN"):
        s = f"regexp_replace({s}, '[^\\x00-\\x7f{cls}]', 'é', 'g')"
    return f"replace({s}, 'é', 'q')"
