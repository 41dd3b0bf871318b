"""Layout configurations: a JSON schema, its parts, its encoding, and the space of its parameters.

``{"method": "tif;slicing;a;dyn;2.1;0.5"}`` is a single access path. ``{"refine": "elemfreq",
"fanout": [...]}`` (or split, slice, hybrid) composes paths, each with a ``range``; a JSON array
has one schema for each ``band_range``.
"""

from __future__ import annotations

import itertools
import json
import random
import re
from dataclasses import dataclass, field

#: The keys of a schema, and the encoding's order of element-first methods.
KEYS = ("band_range", "bands", "range", "split", "slice", "refine", "hybrid", "method", "fanout")
METHODS = ("tif;basic", "tif;slicing;a;dyn", "tif;sharding;dyn", "tif;hint;mrg;dyn")
ENCODING = ("basic", "slicing", "sharding", "hint", "alpha", "beta", "boundary", "levels")
TOLERANCE = 0.01
#: Templates of the design space by group.
TEMPLATES = {
    "pure": {
        "pure_tif+slicing": {"method": "tif;slicing;a;dyn;[1.8-2.6];[0.3-0.9]"},
        "pure_tif+hint": {"method": "tif;hint;mrg;dyn;[1.3-4.0];[0.5-4.0]"},
        "pure_irhint": {"method": "irhint;perf;[5-16]"},
    },
    "dict2": {
        "refine-elemfreq_tif+slicing_irhint": {
            "refine": "elemfreq",
            "fanout": [{"range": "[0.6-1]-1", "method": "tif;slicing;a;dyn;[1.8-2.8];[0.3-0.9]"}, {"range": "0-p", "method": "irhint;perf;[4-14]"}],
        },
    },
    "temp+dict2": {
        "temporal-bands_refine-elemfreq_tif+basic_tif+slicing_irhint": {
            "bands": "[2-4]",
            "refine": "elemfreq",
            "fanout": [{"range": "[0.5-0.9]-1", "method": "tif;slicing;a;dyn;[1.8-2.6];[0.3-0.9]"}, {"range": "0-p", "method": "irhint;perf;[4-15]"}],
        },
    },
    "obsolete": {
        "pure_tif+basic": {"method": "tif;basic"},
        "pure_tif+sharding": {"method": "tif;sharding;dyn;[1.8-2.8];[0.3-1.6]"},
        "refine-elemfreq_tif+basic_tif+hint_irhint": {
            "refine": "elemfreq",
            "fanout": [{"range": "[0.8-0.95]-1", "method": "tif;basic"}, {"range": "[0.65-0.78]-p", "method": "tif;hint;mrg;dyn;[1.3-4.0];[0.5-4.0]"}, {"range": "0-p", "method": "irhint;perf;[7-15]"}],
        },
        "refine-elemfreq_tif+basic_tif+slicing_irhint": {
            "refine": "elemfreq",
            "fanout": [{"range": "[0.8-0.95]-1", "method": "tif;basic"}, {"range": "[0.65-0.78]-p", "method": "tif;slicing;a;dyn;[1.8-2.6];[0.3-0.9]"}, {"range": "0-p", "method": "irhint;perf;[7-15]"}],
        },
        "refine-elemfreq_tif+hint_irhint": {
            "refine": "elemfreq",
            "fanout": [{"range": "[0.65-0.95]-1", "method": "tif;hint;mrg;dyn;[1.3-4.0];[0.5-4.0]"}, {"range": "0-p", "method": "irhint;perf;[5-15]"}],
        },
        "split-temporal_irhint_irhint_irhint": {
            "split": "temporal",
            "fanout": [{"range": "[0.75-0.95]-1", "method": "irhint;perf;[2-8]"}, {"range": "0-p", "method": "irhint;perf;[2-8]"}, {"range": "0-1", "method": "irhint;perf;[2-5]"}],
        },
        "split-temporal_tif+hint_irhint_irhint": {
            "split": "temporal",
            "fanout": [{"range": "[0.75-0.95]-1", "method": "tif;hint;mrg;dyn;[1.3-4.0];[0.5-4.0]"}, {"range": "0-p", "method": "irhint;perf;[4-9]"}, {"range": "0-1", "method": "irhint;perf;[2-5]"}],
        },
        "split-temporal_tif+slicing_irhint_irhint": {
            "split": "temporal",
            "fanout": [{"range": "[0.75-0.95]-1", "method": "tif;slicing;a;dyn;[1.8-2.6];[0.3-0.9]"}, {"range": "0-p", "method": "irhint;perf;[4-9]"}, {"range": "0-1", "method": "irhint;perf;[2-5]"}],
        },
        "split-temporal_tif+basic_irhint_irhint": {
            "split": "temporal",
            "fanout": [{"range": "[0.75-0.95]-1", "method": "tif;basic"}, {"range": "0-p", "method": "irhint;perf;[5-10]"}, {"range": "0-1", "method": "irhint;perf;[2-7]"}],
        },
        "split-temporal_tif+basic_irhint_tif+slicing": {
            "split": "temporal",
            "fanout": [{"range": "[0.75-0.95]-1", "method": "tif;basic"}, {"range": "0-p", "method": "irhint;perf;[5-10]"}, {"range": "0-1", "method": "tif;slicing;a;dyn;[1.8-2.6];[0.3-0.9]"}],
        },
        "split-temporal_tif+basic_irhint": {"split": "temporal", "fanout": [{"range": "[0.75-0.95]-1", "method": "tif;basic"}, {"range": "0-1", "method": "irhint;perf;[4-12]"}]},
        "split-temporal_tif+slicing_irhint": {
            "split": "temporal",
            "fanout": [{"range": "[0.75-0.95]-1", "method": "tif;slicing;a;dyn;[1.8-2.6];[0.3-0.9]"}, {"range": "0-1", "method": "irhint;perf;[4-13]"}],
        },
        "split-temporal_tif+hint_irhint": {
            "split": "temporal",
            "fanout": [{"range": "[0.75-0.95]-1", "method": "tif;hint;mrg;dyn;[1.3-4.0];[0.5-4.0]"}, {"range": "0-1", "method": "irhint;perf;[4-12]"}],
        },
        "split-temporal_irhint_irhint": {"split": "temporal", "fanout": [{"range": "[0.75-0.95]-1", "method": "irhint;perf;[4-12]"}, {"range": "0-1", "method": "irhint;perf;[4-12]"}]},
        "slice-temporal_tif+basic_irhint": {"slice": "temporal", "fanout": [{"range": "[0.75-0.95]-1", "method": "tif;basic"}, {"range": "0-p", "method": "irhint;perf;[4-14]"}]},
        "slice-temporal_tif+slicing_irhint": {
            "slice": "temporal",
            "fanout": [{"range": "[0.75-0.95]-1", "method": "tif;slicing;a;dyn;[1.8-2.6];[0.3-0.9]"}, {"range": "0-p", "method": "irhint;perf;[4-14]"}],
        },
        "slice-temporal_tif+hint_irhint": {
            "slice": "temporal",
            "fanout": [{"range": "[0.75-0.95]-1", "method": "tif;hint;mrg;dyn;[1.3-4.0];[0.5-4.0]"}, {"range": "0-p", "method": "irhint;perf;[4-14]"}],
        },
        "slice-temporal_irhint_tif+basic": {"slice": "temporal", "fanout": [{"range": "[0.75-0.95]-1", "method": "irhint;perf;[4-14]"}, {"range": "0-p", "method": "tif;basic"}]},
        "slice-temporal_irhint_tif+slicing": {
            "slice": "temporal",
            "fanout": [{"range": "[0.75-0.95]-1", "method": "irhint;perf;[4-14]"}, {"range": "0-p", "method": "tif;slicing;a;dyn;[1.8-2.6];[0.3-0.9]"}],
        },
        "slice-temporal_irhint_tif+hint": {
            "slice": "temporal",
            "fanout": [{"range": "[0.75-0.95]-1", "method": "irhint;perf;[4-13]"}, {"range": "0-p", "method": "tif;hint;mrg;dyn;[1.3-4.0];[0.5-4.0]"}],
        },
    },
}
#: The groups whose schemas have an encoding.
ENCODED = ("pure", "dict2", "temp+dict2")


@dataclass
class Schema:
    method: list[str] = field(default_factory=list)
    fanout: list[Schema] = field(default_factory=list)
    range: str = ""
    band_range: str = ""
    bands: str = ""
    split: str = ""
    slice: str = ""
    refine: str = ""
    hybrid: str = ""

    @staticmethod
    def of(spec: dict) -> Schema:
        if unknown := set(spec) - set(KEYS):
            raise ValueError(f"unknown keys {sorted(unknown)}")
        own = {k: str(spec[k]) for k in KEYS if k in spec and k not in ("method", "fanout")}
        return Schema(method=[m for m in str(spec.get("method", "")).split(";") if m], fanout=[Schema.of(s) for s in spec.get("fanout", [])], **own)

    def spec(self) -> dict:
        """As JSON has it. A fanout with one child is that child."""
        if len(self.fanout) == 1:
            child = self.fanout[0].spec()
            return {k: v for k, v in self.spec_own().items() if k in ("band_range", "bands", "range")} | {k: v for k, v in child.items() if k != "range"}
        return self.spec_own()

    def spec_own(self) -> dict:
        out = {k: getattr(self, k) for k in KEYS if k not in ("method", "fanout") and getattr(self, k)}
        if self.method:
            out["method"] = ";".join(self.method)
        if self.fanout:
            out["fanout"] = [s.spec() for s in self.fanout]
        return out


def without_comments(text: str) -> str:
    """Configuration text as JSON: no # lines, no trailing commas."""
    text = re.sub(r"(?m)^\s*#.*$", "", text)
    return re.sub(r",(\s*[}\]])", r"\1", text)


def parse(text: str) -> list[Schema]:
    """One schema, or one for each band."""
    spec = json.loads(without_comments(text))
    return [Schema.of(s) for s in (spec if isinstance(spec, list) else [spec])]


def serialize(schemas: Schema | list[Schema], pretty: bool = False) -> str:
    specs = [s.spec() for s in ([schemas] if isinstance(schemas, Schema) else schemas)]
    return json.dumps(specs[0] if isinstance(schemas, Schema) or len(specs) == 1 else specs, indent=2 if pretty else None, separators=None if pretty else (",", ":"))


def merged(base: dict, over: dict) -> dict:
    """Configuration stages: later ones win, key by key, at any depth."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def get(config: dict, dotted: str):
    for key in dotted.split("."):
        config = config[key]
    return config


# ---- encoding


def _number(x: float) -> str:
    return f"{x:.6f}".rstrip("0").rstrip(".")


def encode(schema: Schema) -> list[float]:
    """Eight numbers: method one-hot, alpha, beta, the boundary of the two ranges, levels; -1 for
    what a single path lacks."""
    out = [0.0] * len(ENCODING)
    if schema.method and schema.method[0] == "irhint":
        out[4:] = [-1.0, -1.0, 1.0, float(schema.method[2])]
        return out
    if schema.method:
        first, boundary, levels = schema.method, 0.0, -1.0
    elif schema.refine == "elemfreq":
        kinds = {c.method[0]: c for c in schema.fanout if c.method}
        if len(schema.fanout) != 2 or set(kinds) != {"tif", "irhint"}:
            raise ValueError("two children are encoded: one element first, one time first")
        first, levels = kinds["tif"].method, float(kinds["irhint"].method[2])
        boundary = float(kinds["tif"].range.split("-")[0])
    else:
        raise ValueError(f"not to be encoded: {serialize(schema)}")
    which = [i for i, m in enumerate(METHODS) if ";".join(first).startswith(m)]
    if not which:
        raise ValueError(f"not to be encoded: {';'.join(first)}")
    out[which[0]] = 1.0
    numbers = [float(x) for x in first[METHODS[which[0]].count(";") + 1 :]]
    out[4:] = [*(numbers + [-1.0, -1.0])[:2], boundary, levels]
    return out


def decode(code: list[float], tolerance: float = TOLERANCE) -> Schema:
    if len(code) != len(ENCODING):
        raise ValueError("an encoding has eight numbers")
    hot = [i for i in range(4) if code[i] >= 0.5]
    alpha, beta, boundary, levels = code[4:]
    time_first = ["irhint", "perf", _number(levels)]
    if boundary >= 1 - tolerance:
        return Schema(method=time_first)
    if not hot:
        raise ValueError("no element-first method")
    element_first = METHODS[hot[0]].split(";") + ([] if hot[0] == 0 else [_number(alpha), _number(beta)])
    if boundary <= tolerance:
        return Schema(method=element_first)
    at = _number(boundary)
    return Schema(refine="elemfreq", fanout=[Schema(method=element_first, range=f"{at}-1"), Schema(method=time_first, range=f"0-{at}")])


# ---- parameters

_RANGE = re.compile(r"\[(-?[0-9.]+)-(-?[0-9.]+)\]")
_CHOICE = re.compile(r"\[([^\]\[]*,[^\]\[]*)\]")


def _filled(text: str, pick) -> str:
    def value(m: re.Match) -> str:
        lo, hi = m[1], m[2]
        whole = "." not in lo and "." not in hi
        x = pick(float(lo), float(hi))
        return str(round(x)) if whole and (float(hi) > 1) else _number(x)

    return _RANGE.sub(value, text)


def _resolved(spec: dict, pick, choose) -> dict:
    """Ranges and choices filled in; ``p`` is the lower bound of the sibling before."""
    out = {}
    for k, v in spec.items():
        if k != "fanout":
            out[k] = _filled(_CHOICE.sub(lambda m: choose([x.strip() for x in m[1].split(",")]), str(v)), pick)
    if "fanout" in spec:
        children, before = [], ""
        for child in spec["fanout"]:
            own = _resolved(child, pick, choose)
            if "range" in own:
                lo, hi = own["range"].rsplit("-", 1)
                own["range"] = f"{lo}-{before if hi == 'p' else hi}"
                before = lo
            children.append(own)
        out["fanout"] = children
    return out


def sane(schema: Schema) -> bool:
    """Refined by frequency: two or three children, from the rarest range to the most frequent."""
    if schema.refine != "elemfreq":
        return all(map(sane, schema.fanout))
    r = [c.range for c in schema.fanout]
    edges = [tuple(map(float, x.split("-"))) for x in r]
    joined = all(a[0] == b[1] for a, b in itertools.pairwise(edges))
    return 2 <= len(r) <= 3 and r[0].endswith("-1") and r[-1].startswith("0-") and joined and all(a < z for a, z in edges)


def instantiate(template: dict, seed: int, tries: int = 100) -> Schema:
    """Random parameters inside the template's ranges."""
    rng = random.Random(seed)
    for _ in range(tries):
        schema = Schema.of(_resolved(template, rng.uniform, rng.choice))
        if sane(schema):
            return schema
    raise ValueError("no sane schema found")


def closure(template: dict) -> list[dict]:
    """One template for each combination of its choices ``[a,b]``."""
    text = json.dumps(template)
    choices = [[x.strip() for x in m[1].split(",")] for m in _CHOICE.finditer(text) if '"' not in m[1]]
    out = []
    for combination in itertools.product(*choices):
        parts = iter(combination)
        out.append(json.loads(_CHOICE.sub(lambda m, p=parts: m[0] if '"' in m[1] else next(p), text)))
    return out


def corners(template: dict) -> tuple[Schema, Schema]:
    """The schemas of all lower and of all upper ends."""
    lo = Schema.of(_resolved(template, lambda a, _: a, lambda c: c[0]))
    hi = Schema.of(_resolved(template, lambda _, b: b, lambda c: c[0]))
    return lo, hi


def design_space(groups: list[str] | None = None, templates: dict = TEMPLATES) -> list[tuple[str, str, list[float], list[float]]]:
    """(group, template, lower encoding, upper encoding) of all templates in the groups, by default
    of those that have an encoding."""
    out = []
    for group, own in templates.items():
        if group in (ENCODED if groups is None else groups):
            for name, template in own.items():
                for spec in closure(template):
                    lo, hi = corners(spec)
                    out.append((group, name, encode(lo), encode(hi)))
    return out


def variable(lo: list[float], hi: list[float]) -> list[int]:
    """The encoding's places that the template leaves open."""
    return [i for i, (a, b) in enumerate(zip(lo, hi, strict=True)) if a != b]
