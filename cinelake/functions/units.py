"""Exact rationals with a unit, for positions in a video."""

from __future__ import annotations

from fractions import Fraction


class Quantity(Fraction):
    """A fraction with a unit. Results keep the left operand's unit; different units do not mix, plain numbers go with any."""

    unit: str

    def __new__(cls, value, unit: str = "") -> Quantity:
        self = super().__new__(cls, value)
        self.unit = unit
        return self

    def _plain(self, other):
        if isinstance(other, Quantity) and other.unit != self.unit and other.unit and self.unit:
            raise ValueError(f"{self.unit} and {other.unit} do not mix")
        return Fraction(other) if isinstance(other, (int, float, Fraction)) else NotImplemented

    def _made(self, value) -> Quantity:
        return value if value is NotImplemented else Quantity(value, self.unit)

    def __add__(self, other):
        return self._made(Fraction.__add__(self, self._plain(other)))

    def __sub__(self, other):
        return self._made(Fraction.__sub__(self, self._plain(other)))

    def __mul__(self, other):
        return self._made(Fraction.__mul__(self, Fraction(other)))

    def __truediv__(self, other):
        return self._made(Fraction.__truediv__(self, Fraction(other)))

    def __floordiv__(self, other):
        return self._made(Fraction.__floordiv__(self, Fraction(other)))

    def __mod__(self, other):
        return self._made(Fraction.__mod__(self, self._plain(other)))

    def __pow__(self, other):
        return self._made(Fraction(Fraction.__pow__(Fraction(self), other)))

    def __radd__(self, other):
        return self._made(Fraction(other) + Fraction(self))

    def __rsub__(self, other):
        return self._made(Fraction(other) - Fraction(self))

    def __rmul__(self, other):
        return self._made(Fraction(other) * Fraction(self))

    def __rtruediv__(self, other):
        return self._made(Fraction(other) / Fraction(self))

    def __neg__(self):
        return self._made(-Fraction(self))

    def __abs__(self):
        return self._made(abs(Fraction(self)))

    def __eq__(self, other):
        return Fraction(self) == other and (not isinstance(other, Quantity) or other.unit == self.unit)

    def __hash__(self):
        return hash(Fraction(self))

    def __str__(self):
        return f"{Fraction(self)}{self.unit}"


def seconds(value) -> Quantity:
    return Quantity(value, "s")


def frames(value) -> Quantity:
    return Quantity(value, "f")


def rate(value) -> Quantity:
    return Quantity(value, "fps")


def spacing_name(value: Fraction) -> str:
    """A spacing of frames, shown as the rate that it stands for."""
    return f"{1 / Fraction(value)}fps"


def clock_name(value) -> str:
    """Seconds as hours, minutes and seconds, without leading zeros: 3723 is 1h2m3s."""
    whole = int(value)
    rest = Fraction(value) - whole
    hours, minutes, left = whole // 3600, whole // 60 % 60, whole % 60 + rest
    out = (f"{hours}h" if hours else "") + (f"{minutes}m" if minutes else "")
    return out + (f"{left}s" if left or not out else "")
