from settlerank.functions.cleaning import *  # noqa: F401,F403
from settlerank.functions.expressions import *  # noqa: F401,F403
