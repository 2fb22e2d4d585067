"""What each kind of sensor measures and how its measures roll up."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Gauge:
    """A reading that is summed and bounded; ``magnitude`` takes its absolute value first."""

    name: str
    magnitude: bool = False
    non_zero_min: bool = False


@dataclass(frozen=True)
class Schema:
    """``served`` maps a column of the serving view to the rollup column it shows, or to ``avg:<gauge>``."""

    name: str
    gauges: tuple[Gauge, ...]
    counter: str | None = None
    served: tuple[tuple[str, str], ...] = ()

    @property
    def measures(self) -> list[str]:
        return [g.name for g in self.gauges] + ([self.counter] if self.counter else [])

    @property
    def rollup_columns(self) -> list[str]:
        """Stored columns of a rollup row besides sensor, time and granularity."""
        out: list[str] = []
        for g in self.gauges:
            out += [f"sum_{g.name}", f"min_{g.name}", f"max_{g.name}"]
            if g.non_zero_min:
                out.append(f"non_zero_min_{g.name}")
        if self.counter:
            out += [self.counter, f"slot_{self.counter}", f"first_{self.counter}", f"last_{self.counter}"]
        return [*out, "count_agg_rows"]


_PHASES = (1, 2, 3)
POWER = Schema(
    "power",
    tuple(Gauge(f"{m}_{k}", magnitude=True, non_zero_min=m == "power_factor") for m in ("voltage", "current", "power", "power_factor") for k in _PHASES),
    counter="energy_consumed",
    served=(
        ("energy_consumed", "energy_consumed"),
        ("slot_energy_consumed", "slot_energy_consumed"),
        ("max_power", "max_power_1"),
        ("min_power", "min_power_1"),
        ("power", "avg:power_1"),
        ("voltage", "avg:voltage_1"),
        ("current", "avg:current_1"),
        ("agg_row_count", "count_agg_rows"),
    ),
)
TEMPERATURE = Schema(
    "temperature",
    (Gauge("temperature"),),
    served=(("temperature", "avg:temperature"), ("min_temperature", "min_temperature"), ("max_temperature", "max_temperature")),
)
_CLIMATE = ("temperature", "humidity", "battery_voltage")
TEMPERATURE_HUMIDITY = Schema(
    "temperature_humidity",
    tuple(Gauge(m) for m in _CLIMATE),
    served=(*((m, f"avg:{m}") for m in _CLIMATE), *((f"{b}_{m}", f"{b}_{m}") for m in _CLIMATE for b in ("min", "max"))),
)
REGISTRY: dict[str, Schema] = {s.name: s for s in (POWER, TEMPERATURE, TEMPERATURE_HUMIDITY)}


def schema(name: str) -> Schema:
    if name not in REGISTRY:
        raise ValueError(f"unknown schema {name!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name]
