"""What the registry queries read once, and their verdicts."""

from pyspark.sql import functions as F

from marketspark.operators import registry as R


def test_claims_read_the_accepted_changes_once(spark):
    n = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def met(email):
        n.add(1)
        return email

    changes = spark.createDataFrame(
        [("a", "upsert", "new@x.io", 1, 1, None), ("b", "delete", "b@x.io", 2, 2, None), ("c", "upsert", "c@x.io", 3, 3, "invalid_whatsapp")],
        "vendor_id string, op string, email string, ts long, seq long, reason string")
    staff = spark.createDataFrame([("a@x.io", "vendor", "a", None), ("b@x.io", "vendor", "b", None), ("c@x.io", "vendor", "c", None)],
                                  "email string, role string, vendor_id string, user_id string")
    users = spark.createDataFrame([(u, e, {"role": "vendor", "k": "1"}) for u, e in
                                   (("u1", "A@x.io"), ("u2", "b@x.io"), ("u3", "c@x.io"), ("u4", "new@x.io"))],
                                  "id string, email string, claims map<string,string>")
    acc = R.keep_staff_changes(changes.withColumn("email", met("email")))
    now = R.reassign_vendor_staff(staff, acc, users)
    out = {r["id"]: r["claims"] for r in R.user_claims(users, now, staff_before=staff, accepted=acc).collect()}
    assert out == {"u1": "k=1", "u2": "k=1", "u3": "k=1;role=vendor;vendor_id=c", "u4": "k=1;role=vendor;vendor_id=a"}
    assert n.value <= changes.count()


def test_verdicts_in_the_order_of_the_call(spark):
    changes = spark.createDataFrame(
        [(1, "v1x", "upsert", "boss@x.io", "0801234567890", "Shop", "", ""), (2, "v1x", "delete", "boss@x.io", None, None, "bad", None),
         (3, "v1x", "upsert", "x@x.io", "0801234567890", "Shop", "bad", ""), (4, "!", "delete", "boss@x.io", None, None, None, None),
         (5, "v1x", None, "boss@x.io", None, None, None, None), (6, "v1x", "upsert", "x@x.io", "0801234567890", " ", "", ""),
         (7, "v1x", "upsert", "x@x.io", "0801234567890", "Shop", "4.5", "3"), (8, "v1x", "upsert", "boss@x.io", "1", "Shop", "bad", "")],
        "seq long, id string, op string, email string, whatsapp string, name string, rating string, review_count string")
    staff = spark.createDataFrame([("Boss@x.io", "admin", None, None)], "email string, role string, vendor_id string, user_id string")
    out = R.clean_vendor_changes(changes, staff).select("seq", "reason")
    assert dict(map(tuple, out.collect())) == {1: "admin_email", 2: None, 3: "invalid_number", 4: "invalid_vendor_id", 5: "unsupported_action",
                                               6: "name_required", 7: None, 8: "invalid_whatsapp"}
