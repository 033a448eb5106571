"""Fixed values that must equal the original pipeline's for identical results.

Fixed values (stated plainly, in natural order):
- floor inside safe logarithms: 1e-6
- token order: CLS, MUON, MUON, JET, JET, JET, JET; type ids 0=CLS, 1=MUON, 2=JET
- token type ids per slot: [0, 1, 1, 2, 2, 2, 2]
- number of tokens 7, maximum jets 4, feature width 16
- class labels: ggH=0, VBF=1, DY=2
- curation window [115, 135) with 10000 kept rows per source and seed 42
- loading window [115, 135] compared in float32
- folds: 4; train folds {0, 1}, validation {2}, test {3}
- standard-deviation floor: std < 1e-6 becomes 1.0
- mass-bin candidates K = [6, 8, 10, 12, 15], at least 500 rows per bin
- adversary lambda_max 0.5 with 5 warm-up epochs
- early stopping patience 8, min_delta 1e-4
- evaluation batch size 2048; score bins 6; histogram bins per score bin 40
- top-decile quantile 0.90; correlation guard 1e-12
"""

EPS = 1e-6
N_TOKENS = 7
MAX_JETS = 4
X_DIM = 16
TOKEN_TYPES = [0, 1, 1, 2, 2, 2, 2]
TYPE_CLS, TYPE_MUON, TYPE_JET = 0, 1, 2
LABELS = {"ggH": 0, "VBF": 1, "DY": 2}
LABEL_NAMES = ["ggH", "VBF", "DY"]

SELECT_WINDOW = (115.0, 135.0)
SELECT_N_KEEP = 10000
SELECT_SEED = 42
LOAD_WINDOW = (115.0, 135.0)

N_FOLDS = 4
SPLIT_FOLDS = {"train": [0, 1], "val": [2], "test": [3]}

STD_FLOOR = 1e-6

CANDIDATE_K = [6, 8, 10, 12, 15]
MIN_BIN_COUNT = 500
LAMBDA_MAX = 0.5
WARMUP_EPOCHS = 5

PATIENCE = 8
MIN_DELTA = 1e-4

EVAL_BATCH = 2048
N_SCORE_BINS = 6
N_HIST_BINS = 40
PURITY_QUANTILE = 0.90
CORR_GUARD = 1e-12

# Input schema: the 33 numeric event columns, in the configured order.
MET_COLUMNS = ["MET_pt", "MET_phi"]
MUON_FIELDS = ["pt", "eta", "phi", "mass"]
JET_FIELDS = ["pt", "eta", "phi", "mass", "qgl"]
EVENT_COLUMNS = (
    MET_COLUMNS
    + [f"mu{i}_{f}" for i in (1, 2) for f in MUON_FIELDS]
    + ["dimuon_mass", "dimuon_pt_log", "njets_nominal"]
    + [f"jet{j}_{f}_nominal" for j in range(1, MAX_JETS + 1) for f in JET_FIELDS]
)
JET_COLUMNS = [c for c in EVENT_COLUMNS if c.startswith("jet")]
