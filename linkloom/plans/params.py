"""Parameters of the registered queries: the reference's caps for its own blockers, which are the defaults of BlockConfig;
small ones for the address blockers, so that they bind on the driver tables."""

from linkloom.operators.evaluate import thresholds
from linkloom.operators.postings import BlockConfig

MAX_DF = BlockConfig.max_df
CAPS = {name: getattr(BlockConfig, name) for name in ("posting_cap", "name_cap", "number_cap", "address_cap")}
F2 = {"df_fraction": 0.05, "bucket_cap": 20, "ref_k": 5, "s1_k": 5, "min_shared": 2}
PILOT = {"df_fraction": 0.05, "bucket_cap": 20, "ref_k": 5, "min_shared": 2}
THRESHOLDS = thresholds("0.10", "0.99", "0.05")
SCORE_AT = 0.4
