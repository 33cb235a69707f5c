"""Atom patterns as SQL expressions: a pattern is read once by the driver and becomes higher-order functions over a record's nodes.

The expressions are texts for F.expr, as an expression of a rule set made call by call takes the driver half a minute.

Nodes are array<struct<atom_id, element, aromatic, charge, hydrogens, degree, ring_count, ring_sizes, near>>, with near an
array<struct<to, bond, in_ring>>; atom_id is the place in the array. A match is an array of atom ids, one for each pattern atom.

Read here: element and aromatic symbols, `*`, `a`, `A`, `#n`, `Xn`, `Dn`, `Hn`, `Rn`, `rn`, charges, `!` `&` `,` `;`, `$(...)`,
bonds `-` `=` `#` `:` `~` `@` with `!`, branches, ring closures and atom maps. Anything else raises ValueError.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

# fixed values: atomic numbers of the elements that occur
NUMBERS = {0: "*", 1: "H", 5: "B", 6: "C", 7: "N", 8: "O", 9: "F", 11: "Na", 14: "Si", 15: "P", 16: "S", 17: "Cl", 34: "Se", 35: "Br", 50: "Sn", 53: "I"}
BONDS = {"-": 1, "=": 2, "#": 3, ":": 4}
PRIMITIVE = re.compile(r"#(\d+)|([XDHRr])(?![a-z])(\d*)|([+-])(\d*)|(\*|[aA](?![a-z]))|(Cl|Br|Si|Se|Na|Sn|[BCNOPSFI])|([bcnops])")


@dataclass
class Pattern:
    """Atoms as test texts, their map numbers, and links (from, to, bond) in reading order; a link to an earlier atom closes a ring."""

    text: str
    atoms: list[str] = field(default_factory=list)
    maps: list[int | None] = field(default_factory=list)
    links: list[tuple[int, int, str]] = field(default_factory=list)


def _closing(text: str, at: int, pair: str) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == pair[0]) - (text[i] == pair[1])
        if not depth:
            return i
    raise ValueError(f"unclosed {pair[0]} in {text}")


def read(text: str) -> Pattern:
    """The pattern of a text; ValueError if it can't be read."""
    p, stack, rings, last, bond, at = Pattern(text), [], {}, None, "", 0
    while at < len(text):
        c = text[at]
        if c in "-=#:~@!":
            bond += c
        elif c == "(":
            stack.append(last)
        elif c == ")":
            if not stack:
                raise ValueError(f"unopened ) in {text}")
            last = stack.pop()
        elif c.isdigit():
            if last is None:
                raise ValueError(f"ring closure without an atom in {text}")
            if c in rings:
                other, first = rings.pop(c)
                p.links.append((last, other, bond or first))
            else:
                rings[c] = (last, bond)
            bond = ""
        else:
            if c == "[":
                end = _closing(text, at, "[]")
                body = text[at + 1 : end]
            else:
                m = re.match(r"Cl|Br|[BCNOPSFIbcnops*aA]", text[at:])
                if not m:
                    raise ValueError(f"unknown {c} in {text}")
                body, end = m[0], at + len(m[0]) - 1
            number = re.search(r":(\d+)$", body)
            p.atoms.append(body[: number.start()] if number else body)
            p.maps.append(int(number[1]) if number else None)
            if last is not None:
                p.links.append((last, len(p.atoms) - 1, bond))
            last, bond, at = len(p.atoms) - 1, "", end
        at += 1
    if stack or rings or bond or not p.atoms:
        raise ValueError(f"unfinished pattern {text}")
    for body in p.atoms:  # errors show here and not in a job
        _parts(body)
    return p


def _split(text: str, by: str) -> list[str]:
    out, depth = [""], 0
    for c in text:
        depth += (c in "([") - (c in ")]")
        if c == by and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _parts(body: str) -> list[list[list[tuple[bool, object]]]]:
    """Alternatives within conditions: all of the outer, any of the middle, all of the inner; entries are (wanted, primitive)."""

    def inner(text):
        out, at, wanted = [], 0, True
        while at < len(text):
            if text[at] == "!":
                wanted = not wanted
                at += 1
            elif text[at] == "&":
                at += 1
            elif text.startswith("$(", at):
                end = _closing(text, at + 1, "()")
                out.append((wanted, read(text[at + 2 : end])))
                at, wanted = end + 1, True
            else:
                m = PRIMITIVE.match(text, at)
                if not m or (m[1] and int(m[1]) not in NUMBERS):
                    raise ValueError(f"unknown atom test {text[at:]}")
                out.append((wanted, m))
                at, wanted = m.end(), True
        if not out:
            raise ValueError(f"empty atom test in {body}")
        return out

    return [[inner(x) for x in _split(part, ",")] for part in _split(body, ";")]


def _quoted(element: str) -> str:
    return f"'{element}'"


def _primitive(m, node: str) -> str:
    if isinstance(m, Pattern):
        return starts_at(m, node)
    if m[1]:
        return f"{node}.element = {_quoted(NUMBERS[int(m[1])])}"
    if m[2] in ("X", "D", "H"):
        left = {"X": f"{node}.degree + {node}.hydrogens", "D": f"{node}.degree", "H": f"{node}.hydrogens"}[m[2]]
        return f"{left} = {int(m[3] or 1)}"
    if m[2] == "R":
        return f"{node}.ring_count = {m[3]}" if m[3] else f"{node}.ring_count > 0"
    if m[2] == "r":
        return f"coalesce(array_min({node}.ring_sizes) = {m[3]}, false)" if m[3] else f"{node}.ring_count > 0"
    if m[4]:
        return f"{node}.charge = {int(m[5] or 1) if m[4] == '+' else -int(m[5] or 1)}"
    if m[6]:
        return {"*": "true", "a": f"{node}.aromatic", "A": f"NOT {node}.aromatic"}[m[6]]
    if m[7]:
        return f"({node}.element = {_quoted(m[7])} AND NOT {node}.aromatic)"
    return f"({node}.element = {_quoted(m[8].upper())} AND {node}.aromatic)"


def atom_test(body: str, node: str) -> str:
    """The condition that an atom test puts on the struct named `node`."""
    one = lambda tests: " AND ".join(_primitive(m, node) if wanted else f"NOT ({_primitive(m, node)})" for wanted, m in tests)
    return " AND ".join("(" + " OR ".join(f"({one(tests)})" for tests in alternatives) + ")" for alternatives in _parts(body))


def bond_test(text: str, edge: str) -> str:
    if not text:
        return f"{edge}.bond IN (1, 4)"
    tests, negated = [], ""
    for c in text:
        if c == "!":
            negated = "NOT "
            continue
        tests.append(negated + ("true" if c == "~" else f"{edge}.in_ring" if c == "@" else f"({edge}.bond = {BONDS[c]})"))
        negated = ""
    return " AND ".join(tests)


_names = itertools.count()


def name() -> str:
    """A lambda variable that no enclosing one hides."""
    return f"v{next(_names)}"


def holds(body: str, atom: str) -> str:
    """Whether the atom of that number passes a test."""
    n = name()
    return f"exists(array(nodes[{atom}]), {n} -> {atom_test(body, n)})"


def _linked(p: Pattern, link: tuple[int, int, str], found: str) -> str:
    """Matches that a link allows, with the new atom if it brings one; atoms are read in order, so that atom's place is the length so far."""
    (a, b, bond), m, e = link, name(), name()
    near = f"nodes[{m}[{a}]].near"
    if b < a:
        return f"filter({found}, {m} -> exists({near}, {e} -> {e}.to = {m}[{b}] AND {bond_test(bond, e)}))"
    x = name()
    fits = f"filter({near}, {e} -> {bond_test(bond, e)} AND NOT array_contains({m}, {e}.to) AND {holds(p.atoms[b], f'{e}.to')})"
    return f"flatten(transform({found}, {m} -> transform({fits}, {x} -> concat({m}, array({x}.to)))))"


def _grown(p: Pattern, found: str) -> str:
    """Matches grown from those of the first atom, a link at a time."""
    for link in p.links:
        found = _linked(p, link, found)
    return found


def starts_at(p: Pattern, node: str) -> str:
    """Whether a match of the pattern begins at the node."""
    first = atom_test(p.atoms[0], node)
    return f"({first} AND size({_grown(p, f'array(array({node}.atom_id))')}) > 0)" if p.links else f"({first})"


def matches(p: Pattern) -> str:
    """An array<array<int>>: all matches in order, of those with the same atoms the first."""
    n, x = name(), name()
    found = f"array_sort({_grown(p, f'transform(filter(nodes, {n} -> {atom_test(p.atoms[0], n)}), {x} -> array({x}.atom_id))')})"
    if len(p.atoms) == 1:
        return found
    rows, both, m, i, k = name(), name(), name(), name(), name()
    first = f"filter({both}.rows, ({m}, {i}) -> array_position({both}.keys, array_sort({m})) = {i} + 1)"
    return f"flatten(transform(transform(array({found}), {rows} -> struct({rows} AS rows, transform({rows}, {k} -> array_sort({k})) AS keys)), {both} -> {first}))"
