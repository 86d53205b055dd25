"""Speed profiles in INI form and access trees, for tags.Profile."""

from __future__ import annotations

import configparser
import io
from dataclasses import dataclass

from wayfold.operators.tags import Profile, access_chain


@dataclass
class SpeedClass:
    """A value of `highway`: limits in km/h, average in per cent of the limit, seconds for turns into
    it, and whether turns out of it give way to classes of a higher priority. city_speed is the limit within places where no
    limit is tagged."""

    value: str
    priority: int = 0
    max_speed: float = 50.0
    city_speed: float = 50.0
    average: float = 80.0
    pedestrian: bool = False
    left_penalty: float = 0.0
    right_penalty: float = 0.0
    yields_left: bool = False
    yields_right: bool = False
    yields_straight: bool = False


def access_tree(text: str) -> list[tuple[str, str]]:
    """(child, parent) of each line of an access tree; a parent stands before its children, the root is its own."""
    pairs = [tuple(line.split()) for line in text.splitlines() if line.strip()]
    seen: set[str] = set()
    for pair in pairs:
        if len(pair) != 2 or (pair[1] not in seen and pair[0] != pair[1]):
            raise ValueError(f"not a child with a parent before it: {' '.join(pair)}")
        seen.add(pair[0])
    return pairs


def load(text: str, tree: list[tuple[str, str]]) -> tuple[Profile, list[SpeedClass]]:
    """A profile from INI text: [profile] with access and languages, sections [class VALUE], [way N] and [node N]."""
    parsed = configparser.ConfigParser(interpolation=None)
    parsed.read_string(text)
    own = parsed["profile"]
    speeds, modifiers = [], {"way": [], "node": []}
    for name in parsed.sections():
        kind, _, rest = name.partition(" ")
        s = parsed[name]
        if kind == "class":
            speeds.append(SpeedClass(rest, s.getint("priority", 0), s.getfloat("max_speed", 50), s.getfloat("city_speed", 50), s.getfloat("average", 80), s.getboolean("pedestrian", False), s.getfloat("left_penalty", 0), s.getfloat("right_penalty", 0), *(s.getboolean(f"yields_{k}", False) for k in ("left", "right", "straight"))))
        elif kind in modifiers:
            modifiers[kind].append((s["key"], s.get("value"), s["kind"], s.getint("amount", 0)))
    profile = Profile([s.value for s in speeds], access_chain(tree, own.get("access", "motorcar")), own.get("languages", "name").split(","), modifiers["way"], modifiers["node"])
    return profile, speeds


def save(profile: Profile, speeds: list[SpeedClass]) -> str:
    """The INI text that load reads."""
    out = configparser.ConfigParser(interpolation=None)
    out["profile"] = {"access": profile.access[0], "languages": ",".join(profile.languages)}
    for s in speeds:
        out[f"class {s.value}"] = {k: str(v) for k, v in vars(s).items() if k != "value"}
    for kind, rows in (("way", profile.way_modifiers), ("node", profile.node_modifiers)):
        for i, (key, value, what, amount) in enumerate(rows):
            out[f"{kind} {i}"] = {"key": key, **({"value": value} if value is not None else {}), "kind": what, "amount": str(amount)}
    text = io.StringIO()
    out.write(text)
    return text.getvalue()
