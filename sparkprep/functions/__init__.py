from .constants import *  # noqa: F401,F403
from .numeric import clip, nan_to_null, sample_excess_kurtosis, sample_skewness, skew_label  # noqa: F401
from .text import (  # noqa: F401
    coerce_currency_number, na_tokens_to_null, strip_currency, title_case, to_number, trim_all,
)
from .types import (  # noqa: F401
    any_numeric_columns, encodable_columns, numeric_columns, temporal_columns, text_columns,
)
