"""Selection rules as score functions of (time, width, reference time, reference width).

Each rule is plain arithmetic, so the same function builds a Spark column and
works on the arrays of the closed-loop fold. The lowest score wins; ties go to
the lowest rank.
"""

from __future__ import annotations

from collections.abc import Callable


def squared(difference, scale: float):
    ratio = difference / scale
    return ratio * ratio


def standard_rules(t_scale: float, w_scale: float) -> dict[str, Callable]:
    return {
        "FIRST": lambda t, w, ref, ref_w: t,
        "LAST": lambda t, w, ref, ref_w: -t,
        "T": lambda t, w, ref, ref_w: squared(t - ref, t_scale),
        "W": lambda t, w, ref, ref_w: squared(w - ref_w, w_scale),
        "TW": lambda t, w, ref, ref_w: squared(t - ref, t_scale) + squared(w - ref_w, w_scale),
    }
