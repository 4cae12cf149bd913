"""The canonical measurement table and how three sites' tables map to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.harmonize import Mapping
from ..operators.qc import RANGES

COLUMNS = ["ID", "TYPE", *RANGES]
SIDED = ("DIST_SupScapularAngToC7", "DIST_SupScapularAngToT10", "DIST_SternalEndClavicleToSternalManubrium")


def _same_names() -> Mapping:
    """Sites whose columns bear the canonical names but have the sides of three distances apart."""
    means = {f"{c}_AVG_cm": (f"{c}_RIGHT_cm", f"{c}_LEFT_cm") for c in SIDED}
    return Mapping({c: c for c in COLUMNS if c not in means and c != "PONDERAL_INDEX_kg_m3"}, {}, means)


# Column names of the Barcelona table, in its own language and spacing.
BARCELONA = Mapping(
    {
        "ID": "Code",
        "TYPE": "Type",
        "AGE": "Age",
        "HEIGHT_cm": "Altura_m",
        "WEIGHT_kg": "Peso_kg",
        "PER_Skull_cm": "Perimetro_craneal_cm",
        "PER_Neck_cm": "Perimetro_cuello_cm",
        "THICK_WingedNeck_cm": "Grosor_cuello_alado_cm",
        "DIST_SupScapularAngToC7_AVG_cm": "Distancia de angulo superior escapular a C7",
        "DIST_SupScapularAngToT10_AVG_cm": "Distancia de angulo superior escapular a T10",
        "DIST_C7ToT10_cm": "Distancia_C7_t10",
        "DIST_Hand_AVG_cm": "Distancia_muneca_a_dedo3_cm",
        "DIST_LowerLeg_MEDIAL_AVG_cm": "Distancia_condilo_medial_tibia_a_maleolo_medial_cm",
        "DIST_Foot_AVG_cm": "Distancia_astragalo_a_dedo2_pie_cm",
        "PER_Abdominal_cm": "Perimetro_abdominal_cm (debajo de las costillas)",
        "DIST_BetweenSupAntIliacCrest_cm": "Distancia de cresta ilíaca antero superior a cresta ilíaca antero superior",
        "PER_Hip_cm": "Perimetro_cadera_cm (coxofemoral)",
        "DIST_SternalEndClavicleToSternalManubrium_AVG_cm": "Distancia_extremo_esternal_clavicula_a_manubrio_esternal_cm",
        "DIST_ManubriumToXiphoidApophysis_cm": "Distancia_manubrio_a_apofisis_xifoides_cm",
        "DIST_ManubriumToCentralNavel_cm": "Distancia_manubrio_a_ombligo_cm",
    },
    {"HEIGHT_cm": 100.0},
    {
        "LONG_Arm_AVG_cm": ("Longitud_brazo_derecho_cm (Tubérculo mayor a punta dedo 3)", "Longitud_brazo_izquierdo_cm (Tubérculo mayor a punta dedo 3)"),
        "DIST_UpperArm_AVG_cm": ("Distancia_brazo_derecho_cm (punto medio del tubérculo mayor a fosa del codo)", "Distancia_brazo_izquierdo_cm (punto medio del tubérculo mayor a fosa del codo)"),
        "DIST_Forearm_AVG_cm": ("Distancia_antebrazo_derecho_cm (fosa del codo a línea muñeca)", "Distancia_antebrazo_izquierdo_cm (fosa del codo a línea muñeca)"),
        "LONG_Leg_AVG_cm": ("Longitud_pierna_derecha_cm (espina ilíaca antero superior al maleolo medial)", "Longitud_pierna_izquierda_cm (espina ilíaca antero superior al maleolo medial)"),
        "DIST_Thigh_AVG_cm": ("Distancia_muslo_derecho_cm (troncanter mayor a condilo lateral)", "Distancia_muslo_izquierdo_cm  (troncanter mayor a condilo lateral)"),
        "DIST_LowerLeg_LATERAL_AVG_cm": ("Distancia_pantorrilla_derecha_cm (condilo lateral al maleolo lateral)", "Distancia_pantorrilla_izquierda_cm  (condilo lateral al maleolo lateral)"),
    },
)
SITES = {"CO": _same_names(), "ES": BARCELONA, "BR": _same_names()}


def dictionary(spark: SparkSession) -> DataFrame:
    """(position, column, kind, unit, averaged, low, high, sources): the canonical columns, their bounds, and each site's names for them."""
    rows = []
    for i, c in enumerate(COLUMNS):
        unit = next((u for u in ("kg_m3", "cm", "kg") if c.endswith("_" + u)), "years" if c == "AGE" else None)
        names = {site: m.means.get(c) or ((m.columns[c],) if c in m.columns else ()) for site, m in SITES.items()}
        low, high = RANGES.get(c, (None, None))
        rows.append((i, c, "text" if c in ("ID", "TYPE") else "number", unit, "_AVG_" in c, None if low is None else float(low), None if high is None else float(high), {s: list(n) for s, n in names.items()}))
    return spark.createDataFrame(rows, "position int, column string, kind string, unit string, averaged boolean, low double, high double, sources map<string,array<string>>")
