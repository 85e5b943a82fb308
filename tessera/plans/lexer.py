"""Tokens of the expression layer: glyphs and keywords are one token."""

from __future__ import annotations

import re
from dataclasses import dataclass


class AlgebraError(ValueError):
    """A query that cannot be read, bound or run."""


GLYPHS = {
    "σ": "SELECT", "π": "PROJECT", "ρ": "RENAME", "γ": "GROUP", "τ": "SORT", "λ": "LIMIT", "δ": "DISTINCT", "ω": "WHY", "μ": "UNNEST", "∀": "FORALL",
    "∪": "UNION", "⊎": "UALL", "⊔": "OUNION", "−": "DIFF", "∆": "SYMDIFF", "∩": "INTER", "⋈": "JOIN", "⨝": "><", "⟕": "LJOIN", "⟖": "RJOIN", "⟗": "FJOIN",
    "⋉": "SEMI", "▷": "ANTI", "×": "CROSS", "÷": "DIV", "∘": "COMPOSE", "∧": "AND", "∨": "OR", "¬": "NOT", "∈": "IN", "∉": "NOTIN", "⊥": "NULL",
    "→": "->", "≠": "!=", "≤": "<=", "≥": ">=", "↔": "<->", "⁺": "⁺",
}
_SAME = {"|><|": "FJOIN", "|><": "LJOIN", "><|": "RJOIN", "<>": "!=", "MINUS": "DIFF", "EXCEPT": "DIFF", "INTERSECT": "INTER", "DEE": "UNIT", "DUM": "EMPTY"}
_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<str>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
    |(?P<tick>`(?:[^`\n]|``)+`)
    |(?P<param>\$[^\W\d]\w*)
    |(?P<sym>\|><\||\|><|><\||><|<->|->|:=|!~\*|!~|~\*|~|!=|<>|<=|>=|\|\||[(){}\[\],.;:+*/%<>=|?-])
    |(?P<glyph>[σπρστλδωμγ∀∪⊎⊔−∆∩⋈⨝⟕⟖⟗⋉▷×÷∘∧∨¬∈∉⊥→≠≤≥↔⁺])
    |(?P<word>[^\W\dσπρτλδωμγ](?:\w)*)""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


@dataclass(frozen=True)
class Token:
    kind: str  # word tick num str param sym end
    text: str
    key: str  # what grammar rules compare with
    at: int
    touching: bool  # no space before


def tokens(text: str) -> list[Token]:
    out, at, touching = [], 0, False
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise AlgebraError(f"unexpected character {text[at]!r} at {at}")
        kind, raw = m.lastgroup, m[0]
        if kind == "space":
            touching = False
            at = m.end()
            continue
        value, key = raw, raw
        if kind == "word":
            key = _SAME.get(raw.upper(), raw.upper())
        elif kind == "glyph":
            kind, key = "sym" if not GLYPHS[raw].isalpha() else "glyph", GLYPHS[raw]
        elif kind == "tick":
            value, key = raw[1:-1].replace("``", "`"), ""
        elif kind == "str":
            value, key = _string(raw, at), ""
        elif kind == "param":
            value, key = raw[1:], ""
        elif kind == "sym":
            key = _SAME.get(raw, raw)
        out.append(Token(kind, value, key, at, touching))
        touching, at = True, m.end()
    out.append(Token("end", "", "", at, False))
    return out


def _string(raw: str, at: int) -> str:
    quote, body, out, i = raw[0], raw[1:-1], [], 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            if body[i + 1] not in _ESCAPES:
                raise AlgebraError(f"unknown escape \\{body[i + 1]} in the string at {at}")
            out.append(_ESCAPES[body[i + 1]])
            i += 2
        else:
            out.append(c)
            i += 2 if c == quote else 1
    return "".join(out)
