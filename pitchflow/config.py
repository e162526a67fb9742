"""Default thresholds. Fixed values, by operator; pass a changed dict to an operator to override them."""

MIN_EMIT = 0.15
CONTINUITY_WEIGHT = 0.5
BALL_STATE = {"conf": 0.3, "window": 12, "max_gap": 0.5}
KIT = {"same": 8.0, "different": 24.0}
SPRINT = {"window": 5, "threshold": 1.0, "duration": 1.0, "merge": 0.5, "boxes": 5, "penalty": 0.5}
SHOT = {"window": 3, "threshold": 0.12, "duration": 0.3, "merge": 0.3, "direction": 0.7, "conf": 0.3, "min": 0.15, "max": 0.4}
TOUCH = {"distance": 40.0, "debounce": 0.3, "tolerance": 0.15, "conf": 0.3, "window": 0.2, "delta_v": 2.0, "min": 0.1, "max": 0.45}
POSSESSION = {"distance": 70.0, "duration": 0.3, "merge": 0.5, "tolerance": 0.15, "conf": 0.3, "min": 0.1, "max": 0.4}
PASS = {"travel_max": 750.0, "debounce": 1.0, "flight": 0.25, "travel_min": 60.0, "gap": 2.0, "team": 0.5, "min": 0.1, "max": 0.35, "same_colour_required": True, "turnovers": True}
TACKLE = {"gap": 1.5, "lookback": 1.0, "speed": 1.0, "team": 0.5, "min": 0.1, "max": 0.3}
TACKLE_WINDOW = 0.5
BALL = {"speed": 10.0, "reseed": 5, "gap_frames": 15, "penalty": 0.5}
RANK = {"goal": 100.0, "assist": 80.0, "shot": 60.0, "dribble": 40.0, "key_pass": 30.0, "sprint": 20.0, "pass": 10.0}
CLIP = {"before": 3.0, "after": 2.0, "iou": 0.6, "top": 15}
VOTE = {"reads": 2, "agreement": 0.4, "confidence": 0.3}
PROFILE = {"cuts_per_min": 3.0, "static": 1.5, "panning": 6.0, "low_res": 640}
STITCH = {"gap": 1.5, "jump": 3.0, "speed": 2.5, "decay": 0.92, "team": 0.5}
#: Words of an action phrase and its event, the first found in this order.
PHRASES = (
    ("touch", "touch"), ("out of bounds", "out_of_bounds"), ("out of play", "out_of_bounds"), ("pass", "pass"), ("shot", "shot"), ("shoots", "shot"), ("shoot", "shot"),
    ("goal", "goal"), ("scores", "goal"), ("score", "goal"), ("assist", "assist"), ("tackle", "tackle"), ("save", "save"), ("sprint", "sprint"), ("run", "sprint"),
    ("dribble", "dribble"), ("celebrat", "key_moment"),
)
#: The colours that an annotation can name and what each looks like (CIELAB).
COLOURS = {
    "white": (100.0, 0.0, 0.0), "black": (0.0, 0.0, 0.0), "grey": (53.59, 0.0, 0.0), "gray": (53.59, 0.0, 0.0), "red": (53.24, 80.09, 67.2), "maroon": (25.53, 48.05, 38.06),
    "orange": (74.94, 23.93, 78.95), "yellow": (97.14, -21.55, 94.48), "green": (87.73, -86.18, 83.18), "blue": (52.76, -2.7, -3.38), "navy": (12.97, 47.53, -64.7),
    "sky": (91.11, -48.09, -14.13), "cyan": (91.11, -48.09, -14.13), "purple": (29.78, 58.93, -36.49), "pink": (60.32, 98.23, -60.83), "light blue": (83.92, -11.0, -11.0),
    "dark green": (36.08, -43.0, 42.0),
}
DRIBBLE = {"duration": 1.0, "contest": 2.0, "travel": 1.0, "team": 0.5, "min": 0.1, "max": 0.35}
SAVE = {"window": 3, "threshold": 0.12, "duration": 0.3, "merge": 0.3, "conf": 0.3, "keeper": 300.0, "reaction": 1.0, "ratio": 0.3, "min": 0.1, "max": 0.2}
REGION = {"window": 3.0, "confidence": 0.45}
LINE = {"conf": 0.5, "gap": 0.3}
SCOREBOARD = {"frames": 8, "stable": 5, "debounce": 2, "confidence": 0.75}
KEY_MOMENT = {"window": 5, "threshold": 1.0, "duration": 0.5, "merge": 0.5, "top": 6, "yes": 0.55, "min": 0.2}
TIMELINE = {"age": 0.04, "occlusion": 0.10, "partial": 0.15, "grace": 2.0, "hold": 1.5}
TARGET = {"height": 0.6, "bank": 20, "learn": 0.75, "strong": 0.9, "uncertain": 0.75, "reach": 6.0, "weights": {"kit": 0.4, "jersey": 0.3, "height": 0.15, "trajectory": 0.15}}
SELECTION = {"tolerance": 0.15, "tip": 200.0, "duration": 0.5, "share": 0.4, "fallback": 0.35, "weights": (0.4, 0.3, 0.3)}
ATTRIBUTION = {"heights": 4.0, "gap": 1.0}
MANUAL = {"window": 1.0, "confidence": 0.95, "merge": 1.0}
LOCK = {"colour": 8.0, "margin": 0.2}
TEAMS = {"restarts": 10, "seed": 0}
COLOUR_DISTANCE = 8.0
CATEGORIES = {"ball_possession": "possession", "passes": "pass", "turnovers": "turnover", "dribbles": "dribble", "assists": "assist", "goals": "goal", "key_moments": "key_moment"}
LABELS = {"touch": "Touch", "pass": "Pass", "turnover": "Turnover", "sprint": "Sprint", "dribble": "Dribble", "shot": "Shot", "tackle": "Tackle", "save": "Save", "goal": "Goal", "assist": "Assist", "out_of_bounds": "Out of bounds"}
CARD_COUNTS = ("touches", "passes", "turnovers", "sprints", "goals", "assists", "shots", "tackles", "saves", "dribbles")
ANCHORS = {"motion": 3.75, "moving": 5.0, "still": 30.0, "most": 10}
