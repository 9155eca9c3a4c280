"""The deadline arithmetic: years of slack of a finding under a policy, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.functions import dims
from estatelens.functions.assets import round_half_up

#: Default migration years by control class.
MIGRATION_YEARS = {"SELF": 0.5, "VENDOR_UPGRADEABLE": 1.5, "VENDOR_LOCKED": 4.0, "HARDWARE": 6.0, "PROTOCOL_BILATERAL": 5.0}


@dataclass(frozen=True)
class PolicyPack:
    """A versioned policy: when large quantum computers are assumed, fixed deadlines, migration years."""

    pack_id: str
    pack_version: str
    crqc_year: float
    confidentiality_deadline: float | None = None
    authenticity_deadline: float | None = None
    migration_years: dict[str, float] = field(default_factory=lambda: dict(MIGRATION_YEARS))
    trust: str = "SIGNED"


#: The two policies that ship.
EO_14412 = PolicyPack("eo-14412", "1.0.0", 2035.0, 2031.0, 2032.0)
IR_8547_DRAFT = PolicyPack("nist-ir-8547-draft", "0.1.0", 2035.0)
PACKS = {p.pack_id: p for p in (EO_14412, IR_8547_DRAFT)}


def score(track: Column, control_class: Column, pack: PolicyPack, now_year: float, secrecy_years: float | Column = 5.0, migration_years: Column | None = None) -> Column:
    """A struct of x, y, crqc_slack, regulatory_slack, binding, slack_years (rounded) and late (by raw slack).

    secrecy_years and migration_years may be columns, which is where a caller's own rules go in; null
    migration_years fall back to the pack's.
    """
    x = F.when(track == "CONFIDENTIALITY", F.lit(secrecy_years) if not isinstance(secrecy_years, Column) else secrecy_years).otherwise(0.0)
    default = dims.lookup(control_class, pack.migration_years)
    y = default if migration_years is None else F.coalesce(migration_years, default)
    crqc = F.lit(pack.crqc_year - now_year) - (x + y)
    deadline = F.when(track == "CONFIDENTIALITY", F.lit(pack.confidentiality_deadline).cast("double")).otherwise(F.lit(pack.authenticity_deadline).cast("double"))
    regulatory = deadline - now_year - y
    by_date = F.coalesce(regulatory <= crqc, F.lit(False))
    raw = F.when(by_date, regulatory).otherwise(crqc)
    return F.struct(
        x.alias("x"),
        y.alias("y"),
        round_half_up(crqc, 2).alias("crqc_slack"),
        round_half_up(regulatory, 2).alias("regulatory_slack"),
        F.when(by_date, "REGULATORY").otherwise("CRQC").alias("binding"),
        round_half_up(raw, 2).alias("slack_years"),
        (raw < 0).alias("late"),
    )
