"""Training-data operators: each module holds one operator and its registered query.

Nothing outside this folder (but ``corpus_pipeline.py``) imports it, so it can be
removed without touching the rest of the library.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
