"""Training-data operators: one module per operator, queries in ``queries.py``.

Functions shipped to executors go by value and broadcasts hold arrays and numbers only
(a broadcast object's class would be looked up by name), so executors need only the public
libraries (numpy, pyarrow, ...), not this package, on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
