"""Procedures of a route come from everything it calls, however many calls away; a cycle ends."""

from tracewell.operators import routes

FILE = """from x.services.svc import ThingService as ts

@router.get('/far')
def far(db):
    one(db)

def one(db):
    two(db)

def two(db):
    three(db)
    one(db)

def three(db):
    db.execute("CALL DEEP_ONE(1)")

def unused(db):
    db.execute("CALL NEVER(1)")

class ThingService:
    def save(self, x):
        return three(x)

@router.post('/near')
def near(db):
    ts.save(db)
    db.execute("CALL own_proc(1)")
"""


def test_procedures_behind_several_calls(spark):
    df = spark.createDataFrame([(1, "app/routers/r.py", FILE)], "file_id long, path string, text string")
    rows = {r.function_name: r.stored_procedures for r in routes.backend_report(df).collect()}
    assert rows == {"far": "DEEP_ONE", "near": "DEEP_ONE,OWN_PROC"}
