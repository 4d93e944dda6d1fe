"""Specifications written as labels of features: `@cds`, `~gc(40-60%/50bp) & @no(BsmBI_site)`.

@ marks a constraint and ~ an objective. Arguments are separated by commas; `name:value` and `name=value` give a name;
values with | are lists. An argument that a keyword takes already is left to the next position.
"""

from __future__ import annotations

import dataclasses
import inspect
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from ..functions import parsing
from ..operators import specs as S


@dataclass(frozen=True)
class Label:
    role: str
    name: str
    arguments: tuple
    keywords: tuple[tuple[str, object], ...]


def value(text: str):
    text = text.strip()
    return tuple(value(x) for x in text.split("|")) if "|" in text else parsing.number(text)


def find_label(qualifiers: Mapping[str, list[str]]) -> str | None:
    """The first value of `label`, else of `note`, that begins with @ or ~."""
    for key in ("label", "note"):
        if (found := qualifiers.get(key)) and str(found[0]).startswith(("@", "~")):
            return str(found[0])
    return None


def parse(label: str) -> list[Label]:
    out = []
    for part in label.split("&"):
        m = re.fullmatch(r"\s*([@~])\s*(\w+)\s*(?:\((.*)\))?\s*", part, re.S)
        if not m:
            raise ValueError(f"no specification: {part!r}")
        positional, keywords = [], {}
        for arg in filter(None, (x.strip() for x in (m[3] or "").split(","))):
            if named := re.fullmatch(r"([A-Za-z_]\w*)\s*[:=]\s*(.*)", arg, re.S):
                keywords[named[1]] = value(named[2])
            else:
                positional.append(value(arg))
        out.append(Label("constraint" if m[1] == "@" else "objective", m[2], tuple(positional), tuple(keywords.items())))
    return out


def build(label: Label, place: S.Place | None = None, registry: Mapping[str, Callable] | None = None, usage: Mapping[str, Mapping[str, float]] | None = None, subjects: Mapping[str, Sequence[str]] | None = None) -> list[S.Spec]:
    """The specifications of a label at a place. usage: species to codon shares; one without a name has the table named "".
    subjects: names to the sequences that matches are looked for in."""
    known = dict(registry or S.REGISTRY)
    if label.name not in known:
        raise TypeError(f"unknown specification {label.name!r}")
    maker, keywords, rest = known[label.name], dict(label.keywords), list(label.arguments)
    boost = keywords.pop("boost", 1.0)
    species = keywords.pop("species", None)
    if maker is S.EnforceGCContent:
        if rest and isinstance(rest[0], str):
            made = S.EnforceGCContent.parsed(rest[0], place=place, boost=boost)
            return [dataclasses.replace(made, **{k: share(v) for k, v in keywords.items()})]
        keywords = {k: share(v) for k, v in keywords.items()}
        rest = [share(x) for x in rest]
    if maker is S.EnforceMeltingTemperature and rest and isinstance(rest[0], str):
        text = rest.pop(0)
        if one := re.fullmatch(r"\s*([\d.]+)\s*°?\s*C\s*", text):
            keywords["target"] = float(one[1])
        else:
            keywords["mini"], keywords["maxi"] = parsing.temperature_range(text)
    if maker in (S.AvoidMatches, S.AvoidBlastMatches):
        name = rest.pop(0) if rest and isinstance(rest[0], str) else keywords.pop("subjects", "")
        if name not in (subjects or {}):
            raise ValueError(f"no sequences by the name {name!r} to look for matches in")
        keywords["subjects"] = tuple(subjects[name])
    if maker is S.EnforceChoice:
        listed = rest.pop(0) if rest else keywords.pop("choices")
        return [S.EnforceChoice(listed if isinstance(listed, tuple) else (listed,), place=place, boost=boost)]
    if maker in (S.AvoidChanges, S.EnforceChanges):
        for key in ("max_edits", "amount", "minimum"):
            if isinstance(keywords.get(key), str) and keywords[key].endswith("%"):
                keywords[f"{key}_percent"] = parsing.percentage(keywords.pop(key))
        if rest and isinstance(rest[0], str) and rest[0].endswith("%"):
            first = "max_edits_percent" if maker is S.AvoidChanges else "minimum_percent" if label.role == "constraint" else "amount_percent"
            keywords[first] = parsing.percentage(rest.pop(0))
    if maker is S.EnforceChanges and label.role == "objective" and not any(k.startswith(("amount", "minimum")) for k in keywords):
        keywords["amount_percent"] = 100.0
    if maker is S.EnforceSequence and any(isinstance(x, tuple) for x in (*rest, *keywords.values())):
        raise ValueError("alternatives need @choice")
    if maker is S.UniquifyAllKmers:
        second = 0 if "k" in keywords else 1
        if len(rest) > second and isinstance(rest[second], str):
            keywords["reference"] = rest.pop(second)
        if isinstance(wide := keywords.get("reference"), str) and wide not in ("here", "same"):
            keywords["reference"] = parsing.location(wide)
        if "include_reverse_complement" in keywords:
            keywords["both_strands"] = str(keywords.pop("include_reverse_complement")).lower() not in ("0", "false", "no")
    if maker is S.AllowPrimer:
        return S.AllowPrimer(place, *rest, **keywords)
    if maker is S.CodonOptimize or (isinstance(maker, type) and issubclass(maker, S.CodonUsageSpec)):
        species = species or (rest.pop(0) if rest and isinstance(rest[0], str) else "")
        original = keywords.pop("original_species", None)
        if "->" in species:  # from the original host to this one
            original, species = (x.strip() for x in species.split("->"))
        for name in (species, original):
            if name is not None and name not in (usage or {}):
                raise ValueError(f"no codon usage of {name!r}")
        table = dict(usage[species])
        if maker is S.HarmonizeRCA:
            keywords["original_usage"] = tuple(sorted(usage[original if original is not None else species].items()))
        if maker is S.CodonOptimize:
            return [S.CodonOptimize(table, keywords.pop("method", "use_best_codon"), dict(usage.get(original, {})), place=place, boost=boost)]
        return [maker(tuple(sorted(table.items())), *rest, place=place, boost=boost, **keywords)]
    free = [p for p in inspect.signature(maker).parameters if p not in keywords and p not in ("place", "boost")]
    keywords |= dict(zip(free, rest, strict=False))
    if "strand" in keywords:
        keywords["strand"] = {"both": 0, "from_location": None}.get(keywords["strand"], keywords["strand"])
    return [maker(place=place, boost=boost, **keywords)]


def share(x):
    """40% as 0.4; a number stays."""
    return parsing.percentage(x) / 100 if isinstance(x, str) and x.strip().endswith("%") else x


def from_features(features: list[dict], registry: Mapping[str, Callable] | None = None, usage=None, subjects=None) -> tuple[list[S.Spec], list[S.Spec]]:
    """Constraints and objectives of a record's misc_feature features."""
    out: dict[str, list[S.Spec]] = {"constraint": [], "objective": []}
    for f in features:
        if f["type"] == "misc_feature" and (text := find_label(f["qualifiers"] or {})):
            for label in parse(text):
                out[label.role] += build(label, (f["start"], f["end"], f["strand"] or 0), registry, usage, subjects)
    return out["constraint"], out["objective"]


#: Own colours by role.
COLORS = {"constraint": "#3f7fbf", "objective": "#5fbf7f", "edit": "#bf5f3f"}


def to_feature(spec: S.Spec, role: str = "constraint", colors: Mapping[str, str] | None = None, short: bool = False, length: int | None = None, **qualifiers: str) -> dict:
    """A feature that shows the specification, coloured by its role, with a long or short label; without a place of its own
    it covers a sequence of the given length."""
    start, end, strand = spec.place or (0, length or 0, 0)
    label = spec.short_label() if short else spec.label()
    shown = {"label": [("@" if role == "constraint" else "~") + label], "color": [(colors or COLORS)[role]]}
    return {"type": "misc_feature", "start": start, "end": end, "strand": strand, "qualifiers": shown | {k: [v] for k, v in qualifiers.items()}}


def problem_features(constraints: list[S.Spec], objectives: list[S.Spec], before: str, after: str, short: bool = False) -> list[dict]:
    """A problem as features of its record: constraints, objectives, and the edits from before to after."""
    out = [to_feature(s, role, short=short, length=len(after)) for role, specs in (("constraint", constraints), ("objective", objectives)) for s in specs]
    i = 0
    while len(before) == len(after) and i < len(after):
        j = i
        while j < len(after) and before[j] != after[j]:
            j += 1
        if j > i:
            out.append({"type": "misc_feature", "start": i, "end": j, "strand": 0, "qualifiers": {"label": [f"{before[i:j]}=>{after[i:j]}"], "color": [COLORS["edit"]], "is_edit": ["true"]}})
        i = j + 1
    return out


def usage_tables(rows, most: int = 100_000) -> dict[str, dict[str, float]]:
    """species to codon shares, from a table (species, codon, share) of `most` rows at most."""
    out: dict[str, dict[str, float]] = {}
    got = rows.select("species", "codon", "share").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows of codon usage")
    for r in got:
        out.setdefault(r["species"], {})[r["codon"].upper().replace("U", "T")] = float(r["share"])
    return out
