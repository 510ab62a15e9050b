"""Fixed values of the habitat model: codes, profiles, weights, knots and thresholds."""

from __future__ import annotations

SPECIES = ("kitsemampel", "chanterelle", "aspen_bolete", "birch_bolete", "porcini")

#: Tree codes by category; whatever else stands is "other".
TREES = {"pine": "MA", "spruce": "KU", "birch": "KS", "aspen": "HB"}
CATEGORIES = (*TREES, "other")

#: Site group: its codes with their moisture (None: special or unknown), then the scores of SPECIES (None: unknown).
SITES = {
    "nõmme": ({"SM": 0, "KN": 0}, (0.85, 0.70, 0.60, 0.65, 0.70)),
    "loo": ({"LL": 0, "KL": 1, "LU": None}, (0.15, 0.25, 0.70, 0.60, 0.40)),
    "palu": ({"PH": 1, "JP": 1, "MS": 2}, (1.00, 1.00, 0.75, 0.85, 0.95)),
    "laane": ({"JM": 2, "JK": 2}, (0.45, 0.85, 0.90, 0.85, 1.00)),
    "sürja": ({"SL": 2}, (0.20, 0.40, 0.85, 0.75, 0.65)),
    "salu": ({"ND": 2, "SJ": 3}, (0.10, 0.20, 0.85, 0.75, 0.50)),
    "rabastuv": ({"SN": 3, "KM": 3, "KR": 3}, (1.00, 0.45, 0.60, 0.85, 0.40)),
    "sooviku": ({"AN": 3, "TA": 3, "OS": 3, "TR": 3}, (0.25, 0.20, 0.75, 0.85, 0.30)),
    "rohusoo": ({"LD": 4, "MD": 4}, (0.10, 0.10, 0.55, 0.70, 0.15)),
    "samblasoo": ({"SS": 4, "RB": 4}, (0.15, 0.10, 0.35, 0.70, 0.15)),
    "kõdusoo": ({"JO": None, "MO": None}, (None,) * 5),
    "puistang": ({"MP": None, "TP": None}, (None,) * 5),
}

#: Species: host tree (affinity, share at which it saturates).
HOSTS = {
    "kitsemampel": {"pine": (1.0, 0.35), "spruce": (0.65, 0.30), "birch": (0.40, 0.25)},
    "chanterelle": {"pine": (1.0, 0.40), "spruce": (0.75, 0.35), "birch": (0.75, 0.35)},
    "aspen_bolete": {"aspen": (1.0, 0.15), "birch": (0.40, 0.20)},
    "birch_bolete": {"birch": (1.0, 0.20)},
    "porcini": {"spruce": (1.0, 0.30), "pine": (0.90, 0.30), "birch": (0.75, 0.25)},
}

AGE_RANKS = {"A": 0, "S": 1, "N": 2, "L": 3, "K": 4, "V": 5, "Y": 6}

#: Evidence of an ecotone and its weight; the bonus is BONUS times the weighted sum.
EVIDENCE = {"composition": 0.35, "site": 0.25, "age": 0.20, "drainage": 0.10, "length": 0.10}
BONUS, FULL_LENGTH_M, BEST, WORST = 0.3, 200.0, 0.7, 0.3

#: Weights and scales (mm) of the rain of 0 to 3, 3 to 7 and 7 to 14 days ago.
RAIN_SCALES = (8.0, 12.0, 18.0)
RAIN_WEIGHTS = {s: (0.15, 0.35, 0.50) if s in ("kitsemampel", "chanterelle") else (0.20, 0.45, 0.35) for s in SPECIES}

#: Month and day: season's value, linear between, level outside.
SEASONS = {
    "chanterelle": {"06-01": 0.10, "06-15": 0.35, "07-01": 0.85, "07-15": 1.0, "09-10": 1.0, "10-01": 0.35, "10-15": 0.10},
    "kitsemampel": {"07-20": 0.05, "08-01": 0.20, "08-15": 0.85, "08-25": 1.0, "09-20": 1.0, "10-01": 0.30, "10-10": 0.05},
    "aspen_bolete": {"07-01": 0.15, "07-15": 0.65, "08-01": 1.0, "09-20": 1.0, "10-05": 0.30, "10-15": 0.05},
    "birch_bolete": {"07-01": 0.15, "07-20": 0.70, "08-01": 1.0, "09-20": 1.0, "10-05": 0.30, "10-15": 0.05},
    "porcini": {"07-01": 0.10, "07-15": 0.60, "08-01": 1.0, "09-25": 1.0, "10-05": 0.35, "10-15": 0.05},
}

ACCESS_CAP_M = 1500.0
CAR_CLASSES = ("HIGH_CONFIDENCE", "NORMAL", "CONDITIONAL")
CLOSED = "Püsivalt suletud"
ROAD_CLASSES = {
    "HIGH_CONFIDENCE": ("Põhimaantee", "Tugimaantee", "Kõrvalmaantee", "Ramp või ühendustee", "Tänav"),
    "WALK_ONLY": ("Kergliiklustee", "Rada"),
}
OTHER_ROAD = "Muu tee"
OTHER_ROAD_SURFACES = {"NORMAL": ("Püsikate", "Kruuskate", "Kivikate"), "CONDITIONAL": ("Pinnas",)}

MIN_COVERAGE, STALE_HOURS, GATE = 0.7, 6.0, 0.9
SLOTS = {3: 288, 7: 672, 14: 1344}
SLOT_HOURS, DRY_GAP_HOURS, SIGNIFICANT_MM, STRONG_MM, MET_HOURS = 0.25, 6, 5.0, 10.0, 72
SEPARATION_M, TOP, REMOTE_TOP, EXAMPLES = 400.0, 10, 10, 3
GAP_M, CONTACT_M, ECOTONE_BUFFER_M = 10.0, 20.0, 40.0
BLOCK_PROXIMITY_M, BLOCK_EXTENT_M, CLUSTER_EXTENT_M, TARGET_EXTENT_M, TARGET_BLOCKS = 8000.0, 25000.0, 35000.0, 25000.0, (5, 15)
MAX_DEPTH, SHRINK = 5, 0.8
