"""spark-submit entry: ``spark-submit --py-files tesserae.zip run_query.py <query> <input_dir> <output>``."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tesserae.plans.run import main  # noqa: E402

if __name__ == "__main__":
    main()
