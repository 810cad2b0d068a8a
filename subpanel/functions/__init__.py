from subpanel.functions.columns import *  # noqa: F401,F403
from subpanel.functions.quantiles import exact_quantiles  # noqa: F401
