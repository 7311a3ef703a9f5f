"""spark-submit entry point for the batch pipeline.

    zip -r martlet.zip martlet
    spark-submit --py-files martlet.zip submit_etl.py \
        --behavior s3://bucket/log/ --items s3://bucket/items.csv --users s3://bucket/users.csv \
        --out s3://bucket/marts --start 2017-11-01 --end 2017-12-10 --tz Asia/Shanghai

Arguments are those of ``python -m martlet``.
"""

import sys

from martlet.__main__ import main

if __name__ == "__main__":
    main(sys.argv[1:])
