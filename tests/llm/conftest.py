import os

# Small matrices are slower with many threads; must be set before numpy is loaded.
os.environ.setdefault("OMP_NUM_THREADS", "1")
