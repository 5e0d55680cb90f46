"""A planted corpus: functions with known copies of four kinds, to measure a detector against.

Kind 1 are exact copies, 2 renamed ones with other literals, 3 renamed ones with statements put in, 4 other code of
the same behaviour. Everything follows from the seed.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from itertools import combinations

# Donors: {fn} and other slots are identifiers, <...> literals. Their structures differ.
DONORS = {
    "totals": "def {fn}({a}, {b}):\n    {c} = <0>\n    {d} = []\n    for {e} in {a}:\n        if {e}.price > <10> and {e}.count >= <2>:\n            {c} += {e}.price * {e}.count\n            {d}.append(({e}.name, {e}.price))\n        elif {b} is not None:\n            {c} -= {b}.get({e}.name, <1>)\n    {d}.sort(key=lambda {f}: {f}[<1>], reverse=True)\n    return {c}, {d}[:<5>]\n",
    "merge": "def {fn}({a}, {b}):\n    {c}, {d} = <0>, <0>\n    {e} = []\n    while {c} < len({a}) and {d} < len({b}):\n        if {a}[{c}] <= {b}[{d}]:\n            {e}.append({a}[{c}])\n            {c} += <1>\n        else:\n            {e}.append({b}[{d}])\n            {d} += <1>\n    {e}.extend({a}[{c}:])\n    {e}.extend({b}[{d}:])\n    return {e}\n",
    "window": "def {fn}({a}, {b}=<3>):\n    if {b} <= <0>:\n        raise ValueError(<'size'>)\n    {c} = []\n    {d} = sum({a}[:{b}])\n    {c}.append({d} / {b})\n    for {e} in range({b}, len({a})):\n        {d} = {d} + {a}[{e}] - {a}[{e} - {b}]\n        {c}.append({d} / {b})\n    return {c} or None\n",
    "parse": "def {fn}({a}):\n    {b} = dict()\n    if not {a}:\n        return {b}\n    for {c} in {a}.strip(<'?'>).split(<'&'>):\n        {d}, {e}, {f} = {c}.partition(<'='>)\n        if not {e}:\n            {b}.setdefault({d}, []).append(True)\n            continue\n        {b}.setdefault({d}, []).append({f}.replace(<'+'>, <' '>))\n    return {g} if ({g} := {b}) else None\n",
    "retry": "def {fn}({a}, {b}=<3>, {c}=<1>):\n    {d} = None\n    for {e} in range({b}):\n        try:\n            return {a}()\n        except (OSError, TimeoutError) as {f}:\n            {d} = {f}\n            time.sleep({c} * <2> ** {e})\n        finally:\n            log.debug(<'attempt %d'>, {e})\n    raise {d}\n",
    "brackets": "def {fn}({a}):\n    {b} = {{<')'>: <'('>, <']'>: <'['>}}\n    {c} = []\n    for {d}, {e} in enumerate({a}):\n        if {e} in {b}.values():\n            {c}.append(({e}, {d}))\n        elif {e} in {b}:\n            if not {c} or {c}.pop()[<0>] != {b}[{e}]:\n                return {d}\n    return -<1> if not {c} else {c}[-<1>][<1>]\n",
    "flatten": "def {fn}({a}, {b}=<0>):\n    with {a}.lock:\n        yield ({b}, {a}.value)\n        {c} = {a}.children if {a}.children is not None else ()\n        assert isinstance({c}, (list, tuple)), <'children'>\n        for {d} in reversed({c}):\n            yield from {fn}({d}, {b} + <1>)\n        del {c}\n        if {b} == <0> and hasattr({a}, <'close'>):\n            {a}.close(force=not {b}, code=[{e} for {e} in {a}.codes if {e}])\n",
}
VARIANTS = (
    "def {fn}({a}):\n    {b} = {{}}\n    for {c} in {a}:\n        {d} = {c}[<0>]\n        if {d} not in {b}:\n            {b}[{d}] = []\n        {b}[{d}].append({c})\n    {e} = sorted({b}.items(), key=lambda {f}: {f}[<0>])\n    return [({g}, len({h})) for {g}, {h} in {e} if len({h}) > <1>]\n",
    "def {fn}({a}):\n    return [\n        (*{b}, <1> and {c})\n        for *{b}, {c} in Counter(map(itemgetter(<0>), {a})).most_common()\n        if not {c} <= <1>\n    ][::<1>] + list(filter(None, chain.from_iterable(islice({a}, <0>) for {d} in ())))\n",
)
WORDS = ("alpha beta gamma delta node entry value total item batch order client index state buffer record token part frame chunk slot block chain level field "
         "count weight score label group route queue stack table scope phase trace event signal bound limit range query reply block2 store cache owner").split()
VERBS = "collect resolve apply gather reduce select combine prepare compute arrange convert measure balance expand trace".split()


@dataclass(frozen=True)
class Planted:
    id: int
    file: str
    name: str
    kind: int
    group: int
    source: str


def _literal(rng: random.Random, text: str) -> str:
    if text.startswith("'"):
        return "'k%d'" % rng.randint(1000, 9999)
    return str(rng.choice([0, 1, 2, 3, 8, 16, 100]))


def render(template: str, rng: random.Random, kind: int, gap: int = 2) -> tuple[str, str]:
    """(name, source) of a copy of a donor."""
    slots = sorted(set(re.findall(r"\{(\w+)\}", template)) - {"fn"})
    if kind == 1:
        names = dict(zip(slots, WORDS, strict=False)) | {"fn": "original_" + WORDS[len(slots)]}
        literal = lambda x: x
    else:
        names = dict(zip(slots, rng.sample(WORDS, len(slots)), strict=True)) | {"fn": f"{rng.choice(VERBS)}_{rng.choice(WORDS)}_{rng.randint(10, 99)}"}
        literal = lambda x: _literal(rng, x)
    text = re.sub(r"<('[^']*'|\d+)>", lambda m: literal(m.group(1)), template).format(**names)
    if kind == 3:
        lines = text.splitlines()
        text = "\n".join([lines[0], *(f"    checked_{i} = {rng.randint(1, 99)}" for i in range(gap)), *lines[1:]]) + "\n"
    return names["fn"], text


def plant(seed: int = 7, copies: int = 3, gap: int = 1) -> list[Planted]:
    """Groups of copies, one function a file: the first donor as exact copies, the last with gaps, the others renamed; and one
    group of two that do the same by other means."""
    rng = random.Random(seed)
    out: list[Planted] = []
    for group, (name, template) in enumerate(DONORS.items()):
        kind = 1 if group == 0 else 3 if group == len(DONORS) - 1 else 2
        for copy in range(copies):
            fn, text = render(template, rng, 2 if kind == 3 and copy == 0 else kind, gap)
            out.append(Planted(len(out), f"src/{rng.choice(WORDS)}/{name}_{copy}.py", fn, kind, group, text))
    for template in VARIANTS:
        fn, text = render(template, rng, 2)
        out.append(Planted(len(out), f"src/other/v{len(out)}.py", fn, 4, len(DONORS), text))
    return out


def true_pairs(planted: list[Planted]) -> list[tuple[int, int, int]]:
    """(a, b, kind) of all pairs of one group."""
    return [(x.id, y.id, x.kind) for x, y in combinations(planted, 2) if x.group == y.group]


def scatter(planted: list[Planted], host: list[tuple[str, str]], seed: int = 7) -> list[tuple[str, str]]:
    """(file, source) of a host's files with the planted ones among them, each in a directory the host has. The truth is the
    planted list: file names stay, so that a report can be matched by them."""
    rng = random.Random(seed)
    places = sorted({name.rpartition("/")[0] for name, _ in host}) or [""]
    inside = [(f"{rng.choice(places)}/{p.file.rpartition('/')[2]}".lstrip("/"), p.source) for p in planted]
    return sorted([*host, *inside])
