import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.session import ensure_checkpoint_dir, get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark(app="tessera-tests", master="local[4]", shuffle_partitions=4)
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="tessera-ckpt-"))
    yield s


def write_text(dirpath, name, text):
    p = os.path.join(str(dirpath), name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


# Reference sample exports, written anew (three monthly files).
SALES_JAN = """Cust Name,Date Purchased,Amount USD,Email,Phone,Country
Acme Corp,2026-01-05,1200.50,ops@acme.com,+1 (415) 555-0100,US
Globex,2026-01-12,890.00,buy@globex.io,415-555-0142,US
Initech,2026-01-19,2300.75,ar@initech.com,(212) 555 0199,US
Acme Corp,2026-01-05,1200.50,ops@acme.com,+1 (415) 555-0100,US
Umbrella,2026-01-28,540.20,po@umbrella.co,212.555.0177,US
"""
SALES_FEB_ZH = """客户名称,订单日期,金额,邮箱,电话,国家
北京科技,2026-02-03,8800.00,sales@bjkj.cn,+86 138 0000 1111,CN
上海贸易,2026-02-09,15200.50,info@shmy.cn,021-6200-3000,CN
广州实业,2026-02-15,6400.25,gz@gzsy.cn,(020) 8888 6666,CN
北京科技,2026-02-03,8800.00,sales@bjkj.cn,+86 138 0000 1111,CN
深圳电子,2026-02-21,9900.80,hi@szdz.cn,0755-2233-4455,CN
"""
SALES_MAR_DRIFT = """Customer,Order Date,Revenue USD,Email,Phone,Country,Discount
Acme Corp,2026-03-04,1750.00,ops@acme.com,+1 (415) 555-0100,US,0.10
Globex,2026-03-11,1020.00,buy@globex.io,415-555-0142,US,0.00
Initech,2026-03-22,3100.40,ar@initech.com,(212) 555 0199,US,0.05
"""
