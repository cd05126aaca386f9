"""Options of sources: a base and a user's overlay."""

from __future__ import annotations

from collections.abc import Mapping

#: What each module understands, with defaults.
DEFAULTS: dict[str, dict[str, str]] = {"vp": {"charset": "utf-8"}, "pak": {"charset": "utf-8"}, "xcat": {"charset": "latin-1"}}


def merged(base: Mapping[str, Mapping[str, str]], user: Mapping[str, Mapping[str, str]]) -> dict[str, dict[str, str]]:
    """Sections of keys; the user's replace the base's, case aside. A value of `-` removes a key."""
    out: dict[str, dict[str, str]] = {}
    for layer in (base, user):
        for section, values in layer.items():
            own = out.setdefault(section.lower(), {})
            for k, v in values.items():
                own.pop(k.lower(), None)
                if v != "-":
                    own[k.lower()] = v
    return out
