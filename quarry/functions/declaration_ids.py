"""Declaration ids: validation by grammar, and the choice among an element's spellings."""

from __future__ import annotations

import regex

from ..errors import QueryError

MAX_DEPTH, MAX_RANK, MAX_INT = 64, 32, 2**31 - 1
# fixed values: operators whose ids may name their result
CONVERSIONS = ("op_Implicit", "op_Explicit", "op_CheckedExplicit", "op_CheckedImplicit")

_GRAMMAR = regex.compile(
    r"""(?(DEFINE)
    (?P<start>[\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nl}_])
    (?P<part>(?:(?&start)|[\p{Mn}\p{Mc}\p{Nd}\p{Pc}\p{Cf}]))
    (?P<plain>(?&start)(?&part)*+)
    (?P<angles><(?:(?&part)|\$|(?&angles))*+>)
    (?P<name>(?:(?&start)|\$|(?&angles))(?:(?&part)|\$|(?&angles))*+)
    (?P<int>[1-9][0-9]*+)
    (?P<segment>(?&name)(?:`(?&int))?+)
    (?P<qualified>(?&segment)(?:\.(?&segment))*+)
    (?P<bound>(?:0|-?(?&int)):(?:(?&int))?+)
    (?P<suffix>\[\]|\[(?&bound)(?:,(?&bound))*+\]|[*@^]|[|!](?&reference))
    (?P<arguments>\{(?&type)(?:,(?&type))*+\})
    (?P<reference>(?&segment)(?&arguments)?+(?:\.(?&segment)(?&arguments)?+)*+)
    (?P<type>(?:``?(?:0|(?&int))|=FUNC:(?&type)\((?:(?&type)(?:,(?&type))*+)?+\)|(?&reference))(?&suffix)*+)
    (?P<parameters>\((?&type)(?:,(?&type))*+\))
    (?P<member>\#?(?&name)(?:(?&arguments))?+(?:\#(?&name)(?:(?&arguments))?+)*+)
    )""",
    regex.X,
)
_DEFINE = _GRAMMAR.pattern


def _rule(body: str) -> regex.Pattern:
    return regex.compile(_DEFINE + body, regex.X)


_NAMESPACE = _rule(r"(?&plain)(?:\.(?&plain))*+")
_TYPE = _rule(r"(?&qualified)")
_METHOD = _rule(r"(?P<m>(?&member))(?:``(?&int))?+(?:\((?P<first>(?&type))(?P<more>(?:,(?&type))*+)\))?+(?P<to>~(?&type))?+")
_PROPERTY = _rule(r"(?&member)(?&parameters)?+")
_FIELD = _rule(r"(?&member)")


def _clean(value: str | None) -> bool:
    return bool(value) and not regex.search(r"[\s\p{Cc}\p{Cs}]", value)


def _within_limits(value: str) -> bool:
    depth = deepest = 0
    for c in value:
        depth += (c in "{(<[") - (c in "})>]")
        deepest = max(deepest, depth)
    small = all(int(n) <= MAX_INT or x == "-" and int(n) == MAX_INT + 1 for x, n in regex.findall(r"(-?)(\d+)", "".join(regex.findall(r"\[[^\]]*\]|`\d+", value))))
    return deepest <= MAX_DEPTH and small and all(g.count(",") < MAX_RANK for g in regex.findall(r"\[[^\]]*\]", value))


def is_identifier(value: str | None) -> bool:
    return _clean(value) and bool(_rule(r"(?&plain)").fullmatch(value))


def is_namespace_name(value: str | None) -> bool:
    return _clean(value) and bool(_NAMESPACE.fullmatch(value))


def is_type_name(value: str | None) -> bool:
    return _clean(value) and _within_limits(value) and bool(_TYPE.fullmatch(value))


def is_type_id(value: str | None) -> bool:
    return _clean(value) and value.startswith("T:") and is_type_name(value[2:])


def is_member_id(value: str | None, type_id: str) -> bool:
    """Whether the id names a member of the type."""
    if not _clean(value) or value[:2] not in ("M:", "P:", "F:", "E:") or not is_type_id(type_id):
        return False
    owner = type_id[2:] + "."
    if not value[2:].startswith(owner) or not _within_limits(value):
        return False
    body = value[2 + len(owner) :]
    if value[0] == "M":
        m = _METHOD.fullmatch(body)
        conversion = bool(m) and m["m"] in CONVERSIONS
        return bool(m) and (not m["to"] or conversion and bool(m["first"]) and not m["more"])
    return bool((_PROPERTY if value[0] == "P" else _FIELD).fullmatch(body))


def choose_member_id(ids: list[str], type_id: str) -> str:
    """The one id of a member's spellings: all must be canonical; a conversion prefers the one that names its result."""
    distinct = list(dict.fromkeys(ids))
    if not distinct or not all(is_member_id(i, type_id) for i in distinct):
        raise QueryError("source_invalid", f"no canonical id among {ids}")
    named = [i for i in distinct if "~" in i]
    if len(distinct) > 1 and len(named) == 1 and all(regex.search(r"\.(?:" + "|".join(CONVERSIONS) + r")\(", i) for i in distinct):
        return named[0]
    if len(distinct) > 1:
        raise QueryError("source_invalid", f"several ids: {ids}")
    return distinct[0]
