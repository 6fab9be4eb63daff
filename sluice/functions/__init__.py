"""Column functions with the arithmetic of the record algorithms."""

from sluice.functions.arithmetic import ceil_div, cents, coin, floor_div, floor_mod, subrange

__all__ = ["ceil_div", "cents", "coin", "floor_div", "floor_mod", "subrange"]
