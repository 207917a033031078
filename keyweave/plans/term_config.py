"""Parameters of terminology mining, checked before any plan is built."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from typing import Any

# The delimiters and tags used where a configuration names none.
DEFAULT_DELIMITERS = ("·", ":")
DEFAULT_OPEN_TAGS = ("<tag>",)
DEFAULT_CLOSE_TAGS = ("</tag>", "</>")


@dataclass(frozen=True)
class RecordRule:
    id: str
    term_column: str
    key_terms: tuple[str, ...]
    key_regex: bool = False
    enabled: bool = True

    def __post_init__(self):
        for pattern in self.key_terms if self.key_regex else ():
            try:
                re.compile(pattern, re.IGNORECASE)
            except re.error as error:
                raise ValueError(f"rule {self.id}: {pattern!r} is no pattern: {error}") from error

    def required_columns(self) -> set[str]:
        return {self.term_column, "key"}


@dataclass(frozen=True)
class TagSpanRule:
    id: str
    source_columns: tuple[str, ...]
    open_tags: tuple[str, ...] = DEFAULT_OPEN_TAGS
    close_tags: tuple[str, ...] = DEFAULT_CLOSE_TAGS
    enabled: bool = True

    def required_columns(self) -> set[str]:
        return set(self.source_columns)


@dataclass(frozen=True)
class CompoundSplitRule:
    id: str
    source_columns: tuple[str, ...]
    delimiter: str = "·"
    emit_compound: bool = True
    emit_head: bool = True
    emit_suffix: bool = True
    enabled: bool = True

    def required_columns(self) -> set[str]:
        return set(self.source_columns)


Rule = RecordRule | TagSpanRule | CompoundSplitRule


@dataclass(frozen=True)
class Normalization:
    trim: bool = True
    collapse_whitespace: bool = True
    punctuation: Mapping[str, str] = field(default_factory=dict)
    min_term_length: int = 1
    case_insensitive_dedup: bool = True

    def __post_init__(self):
        if self.min_term_length < 1:
            raise ValueError("min_term_length: terms have at least one character")


@dataclass(frozen=True)
class Thresholds:
    containment_min_len: int = 2
    review_short_len_le: int = 1
    review_noise_ratio_ge: float = 0.6

    def __post_init__(self):
        if self.containment_min_len < 1:
            raise ValueError("containment_min_len: at least 1 is needed")
        if self.review_short_len_le < 0:
            raise ValueError("review_short_len_le: a length is never negative")
        if not 0 <= self.review_noise_ratio_ge <= 1:
            raise ValueError("review_noise_ratio_ge: a share lies between 0 and 1")


@dataclass(frozen=True)
class TermConfig:
    rules: tuple[Rule, ...]
    files: tuple[str, ...] = ()
    versions: tuple[str, ...] = ()
    affix_delimiters: tuple[str, ...] = DEFAULT_DELIMITERS
    normalization: Normalization = Normalization()
    thresholds: Thresholds = Thresholds()

    def required_columns(self) -> set[str]:
        """Columns every table must have; rules that are switched off count as well."""
        rules = [r for r in self.rules if not isinstance(r, CompoundSplitRule)]
        required = set().union(*(r.required_columns() for r in rules))
        return required | {"version"} if self.versions else required


# --- reading a configuration ----------------------------------------------------------
#
# A configuration is read by tables: for each kind of rule the fields it has and the reader of each.


def _flag(value: Any, name: str) -> bool:
    return bool(value)


def _mapping(value: Any, name: str) -> Mapping[str, Any]:
    if not isinstance(value or {}, Mapping):
        raise ValueError(f"{name}: a mapping is needed")
    return value or {}


def _items(value: Any, name: str) -> tuple[str, ...]:
    """A list, or one text with commas; outer white space and blank items do not count."""
    parts = value.split(",") if isinstance(value, str) else [] if value is None else value
    if not isinstance(parts, (list, tuple)):
        raise ValueError(f"{name}: give a list, or one text with commas")
    return tuple(filter(None, (str(part).strip() for part in parts)))


def _some_items(value: Any, name: str) -> tuple[str, ...]:
    found = _items(value, name)
    if not found:
        raise ValueError(f"{name}: at least one value is needed")
    return found


def _chosen(value: Any, name: str) -> tuple[str, ...]:
    """A filter: ``*`` or ``all`` among its items lets everything pass, as no item does."""
    found = _items(value, name)
    return found if {"*", "all"}.isdisjoint(map(str.lower, found)) else ()


def _list(what: str):
    def read(value: Any, name: str) -> tuple[str, ...]:
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"{name} needs a list of {what}")
        found = tuple(map(str, value)) if what == "tags" else _items(value, name)
        if not found:
            raise ValueError(f"{name} needs a list of {what}")
        return found

    return read


def _text(value: Any, name: str) -> str:
    if not str(value or "").strip():
        raise ValueError(f"no {name.rpartition(' ')[2]} ({name})")
    return str(value)


@dataclass(frozen=True)
class _Entry:
    """How one field of a rule is read: from the first of ``names`` that is given."""

    field: str
    read: Callable[[Any, str], Any]
    names: tuple[str, ...] = ()
    required: bool = False

    def value(self, raw: Mapping[str, Any], rule: str) -> dict[str, Any]:
        names = self.names or (self.field,)
        given = next((name for name in names if name in raw), names[0] if self.required else None)
        return {} if given is None else {self.field: self.read(raw.get(given), f"{rule} {given}")}


_ENABLED = _Entry("enabled", _flag)
_COLUMNS = _Entry("source_columns", _list("columns"), required=True)
_KINDS: Mapping[str, tuple[type, tuple[_Entry, ...]]] = {
    "record_rule": (
        RecordRule,
        (
            _Entry("term_column", lambda v, n: _text(v, n).strip(), required=True),
            _Entry("key_terms", _some_items, ("key",), required=True),
            _Entry("key_regex", _flag),
            _ENABLED,
        ),
    ),
    "tag_span": (
        TagSpanRule,
        (
            _COLUMNS,
            _Entry("open_tags", _some_items, ("open_tags", "open_tag")),
            _Entry("close_tags", lambda v, n: _list("tags")(v, n) if v else DEFAULT_CLOSE_TAGS),
            _ENABLED,
        ),
    ),
    "compound_split": (
        CompoundSplitRule,
        (
            _COLUMNS,
            _Entry("delimiter", _text),
            *(_Entry(name, _flag) for name in ("emit_compound", "emit_head", "emit_suffix")),
            _ENABLED,
        ),
    ),
}
#: Settings of earlier versions, and what to use instead.
_OLD = {
    "record_rule": {"conditions": "versions of the configuration", "version": "versions of the configuration"},
    "configuration": {"compound_delimiters": "affix_delimiters"},
}


def _refuse_old(raw: Mapping[str, Any], where: str, name: str) -> None:
    for setting in _OLD.get(where, {}).keys() & raw.keys():
        raise ValueError(f"{name}: {setting} is an old setting; use {_OLD[where][setting]}")


def _rule(raw: Any) -> Rule:
    raw = _mapping(raw, "a rule")
    kind, rule_id = (str(raw.get(name, "")).strip() for name in ("type", "id"))
    if kind not in _KINDS:
        raise ValueError(f"no rule type {kind!r}")
    if not rule_id:
        raise ValueError(f"a {kind} rule needs an id")
    _refuse_old(raw, kind, f"rule {rule_id}")
    made, entries = _KINDS[kind]
    values: dict[str, Any] = {}
    for entry in entries:
        values |= entry.value(raw, f"rule {rule_id},")
    return made(id=rule_id, **values)


def _plain_fields(made: type, raw: Mapping[str, Any], **given: Any):
    """A dataclass of numbers and flags: each value is read as the type of its default."""
    values = {f.name: type(f.default)(raw[f.name]) for f in fields(made) if f.name in raw and f.name not in given}
    return made(**values, **given)


def term_config(raw: Any) -> TermConfig:
    """The configuration given as a mapping or as JSON text."""
    if isinstance(raw, str):
        try:
            raw = json.loads(raw.removeprefix("\ufeff"))
        except json.JSONDecodeError as error:
            raise ValueError(f"the configuration is no JSON: {error}") from error
    if not isinstance(raw, Mapping):
        raise ValueError("a configuration is a mapping")
    if int(raw.get("version", 0)) != 1:
        raise ValueError("this reads configurations of version 1 only")
    _refuse_old(raw, "configuration", "the configuration")
    extractors = raw.get("extractors")
    if not isinstance(extractors, (list, tuple)) or not extractors:
        raise ValueError("extractors: at least one rule is needed")
    normal = _mapping(raw.get("normalization"), "normalization")
    signs = _mapping(normal.get("punctuation_normalization"), "punctuation_normalization")
    pairs = _mapping(signs.get("map"), "map") if signs.get("enabled") else {}
    return TermConfig(
        rules=tuple(map(_rule, extractors)),
        files=_chosen(raw.get("files"), "files"),
        versions=_chosen(raw.get("versions"), "versions"),
        affix_delimiters=_items(raw.get("affix_delimiters"), "affix_delimiters") or DEFAULT_DELIMITERS,
        normalization=_plain_fields(
            Normalization, normal, punctuation={str(old): str(new) for old, new in pairs.items()}
        ),
        thresholds=_plain_fields(Thresholds, _mapping(raw.get("thresholds"), "thresholds")),
    )
