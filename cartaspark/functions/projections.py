"""Transverse Mercator by Krueger's series and shifts between datums, as column expressions.

The series run to the fourth power of the third flattening, which is well below a tenth of a millimetre
within a few thousand kilometres of the central meridian.  Parameters are columns or numbers, so rows
of one table may have different projections.  Angles are in degrees, lengths in metres.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: Semi-major axis and inverse flattening of public reference ellipsoids.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "GRS80": (6378137.0, 298.257222101),
    "International1924": (6378388.0, 297.0),
    "Everest1830": (6377276.345, 300.8017),
    "Bessel1841": (6377397.155, 299.1528128),
    "Clarke1866": (6378206.4, 294.978698214),
}


@dataclass(frozen=True)
class TransverseMercator:
    """Ellipsoid (semi-major axis, inverse flattening), natural origin, scale on the central meridian, false origin."""

    ellipsoid: tuple[float, float] = ELLIPSOIDS["WGS84"]
    lon0: Column | float = 0.0
    lat0: Column | float = 0.0
    k0: Column | float = 1.0
    x0: Column | float = 0.0
    y0: Column | float = 0.0

    def _constants(self) -> tuple[float, float, list[float], list[float]]:
        """Eccentricity, radius of the rectifying sphere, series forward and back (fixed values: Krueger's coefficients)."""
        a, f = self.ellipsoid[0], 1 / self.ellipsoid[1]
        n = f / (2 - f)
        radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        return (f * (2 - f)) ** 0.5, radius, alpha, beta

    def _sphere(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """xi and eta on the rectifying sphere, in radians, before scale and origin."""
        e, _, alpha, _ = self._constants()
        phi, lam = F.radians(lat), F.radians(lon - self.lon0)
        t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
        xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
        north, east = xi, eta
        for j, c in enumerate(alpha, 1):
            north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return north, east

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Easting and northing."""
        _, radius, _, _ = self._constants()
        north, east = self._sphere(lon, lat)
        origin, _ = self._sphere(F.lit(0.0) + self.lon0, F.lit(0.0) + self.lat0)
        return radius * self.k0 * east + self.x0, radius * self.k0 * (north - origin) + self.y0

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude; the latitude by three fixed-point steps from the conformal one, each over a hundred times closer."""
        e, radius, _, beta = self._constants()
        origin, _ = self._sphere(F.lit(0.0) + self.lon0, F.lit(0.0) + self.lat0)
        xi, eta = (y - self.y0) / (radius * self.k0) + origin, (x - self.x0) / (radius * self.k0)
        north, east = xi, eta
        for j, c in enumerate(beta, 1):
            north = north - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            east = east - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        isometric = F.atanh(F.sin(north) / F.cosh(east))
        sine = F.sin(north) / F.cosh(east)
        for _ in range(5):
            sine = F.tanh(isometric + e * F.atanh(e * sine))
        return F.degrees(F.atan2(F.sinh(east), F.cos(north))) + self.lon0, F.degrees(F.asin(sine))


def utm(zone: Column | int, south: bool = False) -> TransverseMercator:
    """The projection of a UTM zone on WGS84."""
    return TransverseMercator(lon0=zone * 6 - 183, k0=0.9996, x0=500_000.0, y0=10_000_000.0 if south else 0.0)


def geocentric(lon: Column, lat: Column, ellipsoid: tuple[float, float]) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of a place on an ellipsoid."""
    a, f = ellipsoid[0], 1 / ellipsoid[1]
    e2 = f * (2 - f)
    phi, lam = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1 - e2) * F.sin(phi)


def geographic(x: Column, y: Column, z: Column, ellipsoid: tuple[float, float]) -> tuple[Column, Column]:
    """Longitude and latitude of Earth-centred coordinates near an ellipsoid (Bowring)."""
    a, f = ellipsoid[0], 1 / ellipsoid[1]
    b = a * (1 - f)
    e2 = f * (2 - f)
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * a, p * b)
    sine, cosine = F.sin(t), F.cos(t)
    lat = F.atan2(z + e2 / (1 - e2) * b * sine * sine * sine, p - e2 * a * cosine * cosine * cosine)
    return F.degrees(F.atan2(y, x)), F.degrees(lat)


def shift_datum(lon: Column, lat: Column, source: tuple[float, float], target: tuple[float, float], shift: tuple[float, ...]) -> tuple[Column, Column]:
    """Longitude and latitude on another datum by seven parameters: shifts (m), rotations (arc seconds, position vector), scale (parts per million)."""
    x, y, z = geocentric(lon, lat, source)
    dx, dy, dz = shift[:3]
    rx, ry, rz = (v * 3.141592653589793 / 648000 for v in shift[3:6])
    m = 1 + shift[6] * 1e-6
    return geographic(dx + m * (x - rz * y + ry * z), dy + m * (rz * x + y - rx * z), dz + m * (-ry * x + rx * y + z), target)
