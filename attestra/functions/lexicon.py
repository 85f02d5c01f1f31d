"""Lexicons: word lists by key, profiles as differences, and the patterns derived from them.

A lexicon lives on the driver and enters plans as literal patterns. Patterns are Java regular
expressions with ``(?U)``, so that digits and blanks are those of Unicode.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import BASE, PROFILES

MAY_BE_EMPTY = frozenset({"COLLOQUIAL_ACTIONS", "ENTITY_STOP_PREFIX", "ENTITY_NOISE_PREFIX"})
# Units that would turn common words ("next step", "half a day") into counts.
BANNED_CN_UNITS = frozenset({"步", "半"})
# Fixed value.
CN_DIGITS = "[一二两三四五六七八九十]+"


class LexiconError(ValueError):
    """A lexicon that cannot be read or breaks its contract."""


def alternation(words) -> str:
    """Quoted words, longest first (ties by code point), joined by ``|``."""
    return "|".join("\\Q" + w + "\\E" for w in sorted(set(words), key=lambda w: (-len(w), w)))


#: What Chinese words begin with, and no Latin ones.
WIDE = r"[\u2E80-\uFFFF]"


def finder(words) -> str:
    """A pattern for whether a word is there; only places that can begin one are looked at closely."""
    first = {w[0] for w in words}
    start = WIDE if all("\u2e80" <= c for c in first) else "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(first)) + "]"
    return f"(?={start})(?:{alternation(words)})"


@dataclass(frozen=True)
class Lexicon:
    """``strict`` selects the intended forms of two patterns instead of the compatible ones: verb and
    tail of a complaint must follow each other, and an inline plan word may stand at the start."""

    words: dict = field(hash=False)
    profile: str = "base"
    strict: bool = False

    def __getitem__(self, key: str) -> list:
        return self.words[key]

    def any(self, text: Column, *keys: str) -> Column:
        """Whether ``text`` contains a word of one of the lists."""
        words = [w for k in keys for w in self.words[k]]
        return text.rlike(finder(words)) if words else F.lit(False)

    def hits(self, text: Column, key: str) -> Column:
        """The contained words, in list order."""
        words = self.words[key]
        return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))

    def pattern(self, name: str) -> str:
        w, alt = self.words, alternation
        if name == "num":
            return rf"(?U)\d+(?:\.\d+)?\s*(?:{alt(w['NUM_UNITS'])})"
        if name == "cn_num":
            return rf"(?U)(?:{CN_DIGITS})\s*(?:{alt(w['CN_NUM_UNITS'])})"
        if name == "defer":
            return rf"(?U)[未没]\s*(?:能|被|及)?\s*(?:{alt(w['DEFER_VERBS'])})|{alt(w['DEFER_WORDS'])}"
        if name == "meta":
            verbs, tails = alt(w["META_COMMENT_VERBS"]), alt(w["META_COMMENT_TAILS"])
            return f"(?:{verbs})(?:{tails})" if self.strict else f"{verbs}|{tails}"
        if name == "plan_heading":
            return rf"(?U)^.*?(?:{alt(w['PLAN_WORDS'])})\s*[:：]?\s*$"
        if name == "inline_plan":
            return r"^.{0,4}?(?:计划|安排|打算)[:：]" if self.strict else r"^.(?:0, 4)?(?:计划|安排|打算)[:：]"
        if name == "risk_negated":
            return (  # fixed value
                r"(?U)[零无未没]\s*(?:发生|出现|发现|存在)?\s*(?:重大|安全|责任|重复)?\s*"
                r"(?:事故|投诉|差错|故障|返工|流失|隐患|延误|问题|延期|复现)"
                r"|杜绝[^，。；\s]{0,4}|防患于未燃"
                r"|(?:解决|整改|修复|处理|消除|克服)(?:了|完|毕)?[^，。；\s]{0,5}问题"
            )
        return alt(w[name])


def _flat(base: dict) -> dict:
    return {k: [tuple(f) for f in v] if k == "DOC_TYPE_FAMILIES" else list(v) for k, v in base.items()}


def merge(words: dict, diff: dict) -> dict:
    """A profile's difference applied: additions (once each), removals, then units."""
    out = {k: list(v) for k, v in words.items()}
    for kind in ("add", "remove"):
        for key, some in (diff.get(kind) or {}).items():
            if key not in out or key == "DOC_TYPE_FAMILIES":
                raise LexiconError(f"profile names an unknown list {key!r}; known: {', '.join(sorted(out))}")
            if kind == "add":
                out[key] += [w for w in some if w not in out[key]]
            else:
                out[key] = [w for w in out[key] if w not in some]
    for key, units in (("NUM_UNITS", "add_units"), ("CN_NUM_UNITS", "add_cn_units")):
        out[key] += [u for u in diff.get(units) or [] if u not in out[key]]
    return out


def validate(words: dict) -> None:
    missing = [k for k in BASE if k not in MAY_BE_EMPTY and not words.get(k)]
    if missing:
        raise LexiconError(f"lists missing or empty: {', '.join(missing)}")
    if absent := [k for k in MAY_BE_EMPTY if k not in words]:
        raise LexiconError(f"lists absent (they may be empty): {', '.join(sorted(absent))}")
    if bad := [u for u in words["CN_NUM_UNITS"] if u in BANNED_CN_UNITS]:
        raise LexiconError(f"CN_NUM_UNITS must not hold {', '.join(bad)}")
    if any(isinstance(f, str) or not f for f in words["DOC_TYPE_FAMILIES"]):
        raise LexiconError("each of DOC_TYPE_FAMILIES must be a non-empty list")


def load(profile: str = "", path: str = "", strict: bool = False) -> Lexicon:
    """The default lexicon or that of a JSON file (``base`` and ``profiles``), under a profile."""
    base, profiles = BASE, PROFILES
    if path:
        try:
            data = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, json.JSONDecodeError) as e:
            raise LexiconError(f"lexicon {path}: {e}") from e
        if not isinstance(data, dict) or "base" not in data:
            raise LexiconError(f"lexicon {path} has no base")
        base, profiles = {k: data["base"].get(k, []) for k in BASE}, data.get("profiles", {})
    words = _flat(base)
    if profile:
        if profile not in profiles:
            raise LexiconError(f"no profile {profile!r}; choose from {', '.join(sorted(profiles))}")
        words = merge(words, profiles[profile])
    validate(words)
    return Lexicon(words, profile or "base", strict)
