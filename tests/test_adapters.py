from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapse.operators import clean as C
from lapse.operators import combine as J
from lapse.operators import relative as R
from lapse.schema import SchemaError, require_columns
from lapse.sources import readers as RD
from lapse.sources import registry as REG
from lapse.sources.adapters import REES46_FILES

UTC = timezone.utc


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


@pytest.fixture()
def root(tmp_path):
    return tmp_path


def by(df, key="customer_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def olist_files(root, with_optional=True):
    write(root, "olist_orders_dataset.csv", "\n".join([
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
        "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date",
        "o1,c1,x,2017-01-01 10:00:00,,,2017-01-05 09:00:00,2017-01-05 10:00:00",
        "o2,c2,x,2017-02-01 10:00:00,,,,2017-02-05 10:00:00",
        "o3,c3,x,bad,,,,",
        "o4,c4,x,2020-02-01 10:00:00,,,,",
    ]) + "\n")
    if not with_optional:
        return
    write(root, "olist_customers_dataset.csv",
          "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
          "c1,u1,1,a,b\nc2,u1,1,a,b\nc3,u3,1,a,b\nc4,u4,1,a,b\n")
    write(root, "olist_order_reviews_dataset.csv",
          "review_id,order_id,review_score,review_creation_date,review_answer_timestamp\n"
          "r1,o1,2,2017-02-01 00:00:00,\nr2,o1,5,2017-01-20 00:00:00,\n")
    write(root, "olist_order_payments_dataset.csv",
          "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
          "o1,1,voucher,1,10\no1,2,card,2,20\no2,1,card,1,5\n")
    write(root, "olist_order_items_dataset.csv",
          "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
          "o1,2,p2,s,2017-01-01,5,1\no1,1,p1,s,2017-01-01,7,2\no2,1,p1,s,2017-01-01,4,1\n")
    write(root, "olist_products_dataset.csv",
          "product_id,product_category_name,product_weight_g,product_length_cm,"
          "product_height_cm,product_width_cm\np1,toys,1,1,1,1\n")


def test_olist(spark, root):
    olist_files(root)
    adapter = REG.get_dataset(" Olist ")
    got = by(adapter.events(spark, str(root)), "order_id")
    assert set(got) == {"o1", "o2"}
    a, b = got["o1"], got["o2"]
    assert a["customer_id"] == b["customer_id"] == "u1"
    assert (a["review_score"], b["review_score"]) == (5.0, 5.0)  # earliest; median fill
    # price caps at the 0.999 quantile of (12, 4)
    assert a["price"] == pytest.approx(4 + 8 * 0.999)
    assert (a["transaction_value"], a["payment_type"], a["payment_installments"]) == (30.0, "card", 3)
    assert (a["product_id"], a["item_count"], a["product_category_name"]) == ("p1", 2, "toys")
    assert (a["delivery_delay"], b["delivery_delay"]) == (-1.0, 0.0)  # one hour early is a day
    assert a["event_type"] == "purchase" and "customer_unique_id" not in a


def test_olist_optional_and_required_tables(spark, root):
    olist_files(root, with_optional=False)
    got = by(REG.get_dataset("olist").events(spark, str(root)), "order_id")
    assert got["o1"]["customer_id"] == "c1" and got["o1"]["review_score"] == 0.0
    with pytest.raises(RD.MissingInput):
        REG.get_dataset("olist").load(spark, str(root / "nowhere"))
    write(root, "olist_customers_dataset.csv", "customer_id\nc1\n")
    with pytest.raises(SchemaError):
        REG.get_dataset("olist").load(spark, str(root))


def test_rees46(spark, root):
    head = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
    write(root, REES46_FILES[0], head + "2019-10-01 00:00:00 UTC,cart,1,2,a,b,5.0,7,s1\n"
          "2019-10-01 00:00:01 UTC,odd,1,2,a,b,oops,7,s1\nbad,view,1,2,a,b,1,7,s\n")
    write(root, REES46_FILES[1], head + "2019-11-01 00:00:00 UTC,purchase,1,2,a,b,-3,8,s2\n"
          "2019-11-01 00:00:00 UTC,purchase,1,2,a,b,4,,s2\n"
          "2019-11-02 00:00:00 UTC,purchase,1,2,a,b,4,8,s2\n")
    got = REG.get_dataset("rees46").events(spark, str(root)).orderBy("event_time").collect()
    assert [(r["customer_id"], r["event_type"], r["engagement_signal"]) for r in got] == [
        (7, "cart_add", 2.0), (7, "view", 1.0), (8, "purchase", 3.0)]
    assert got[1]["transaction_value"] == 0.0 and got[0]["session_id"] == "s1"


def test_retailrocket_properties(spark, root):
    write(root, "events.csv", "timestamp,visitorid,event,itemid,transactionid\n"
          "1433221332117,257597,view,355908,\n1433221332117,257597,view,355908,\n"
          "1433224214164,992329,transaction,248676,99\nx,1,view,1,\n1433224214165,5,odd,248676,\n")
    write(root, "item_properties_part1.csv", "timestamp,itemid,property,value\n"
          "1,355908,colour,red\n3,355908,colour,blue\n1,248676,colour,green\n1,355908,same,k\n"
          "1,248676,same,k\n1,777,size,9\n")
    write(root, "item_properties_part2.csv", "timestamp,itemid,property,value\n2,355908,colour,pink\n")
    events = REG.get_dataset("retailrocket").events(spark, str(root))
    got = by(events)
    assert set(got) == {"257597", "992329", "5"} and events.count() == 3
    assert got["257597"]["colour"] == "blue" and "same" not in events.columns and "size" not in events.columns
    assert got["992329"]["event_type"] == "purchase" and got["992329"]["session_id"] == "99"
    assert got["5"]["event_type"] == "other"


def test_online_retail(spark, root):
    head = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
    write(root, "Year 2009-2010.csv", head + "1,a,x,2,01/12/2009 07:45,3,13085,UK\n"
          "C2,a,x,2,01/12/2009 07:45,3,13085,UK\n3,a,x,-1,01/12/2009 07:45,3,13085,UK\n")
    write(root, "Year 2010-2011.csv", head + "4,b,x,1,2010-12-02 08:00:00,5,  ,UK\n"
          "5,b,x,4,2010-12-02 08:00:00,1,77 ,UK\n6,b,x,4,nope,1,77,UK\n")
    got = by(REG.get_dataset("online_retail_ii").events(spark, str(root)))
    assert set(got) == {"13085", "77"}
    assert got["13085"]["event_time"].month == 12 and got["13085"]["transaction_value"] == 6.0
    assert got["77"]["transaction_value"] == 4.0


def test_instacart_timeline_ignores_basket_size(spark, root):
    write(root, "orders.csv", "order_id,user_id,eval_set,order_number,order_dow,order_hour_of_day,days_since_prior_order\n"
          "1,u,prior,1,1,1,\n2,u,prior,2,1,1,10\n3,u,prior,3,1,1,4\n4,u,prior,4,1,1,30\n")
    write(root, "order_products__prior.csv", "order_id,product_id,add_to_cart_order,reordered\n"
          "1,5,1,0\n1,6,2,1\n2,5,1,1\n")
    write(root, "products.csv", "product_id,product_name,aisle_id,department_id\n5,n,1,2\n")
    write(root, "aisles.csv", "aisle_id,aisle\n1,fruit\n")
    write(root, "departments.csv", "department_id,department\n2,food\n")
    events = REG.get_dataset("instacart").events(spark, str(root))
    days = {r["order_number"]: r["event_time"] for r in events.collect()}
    anchor = datetime(2017, 3, 21)
    assert [(anchor - days[i]).days for i in (1, 2, 3, 4)] == [44, 34, 30, 0]
    rows = events.where("product_id = 5").collect()
    assert rows[0]["aisle"] == "fruit" and rows[0]["department"] == "food"
    labels = R.cadence_labels(events).collect()
    # first 2 of 4 orders: gap 10 (zero dropped); later mean 17 > 15
    assert [(r["lapsed"], r["last_observed"]) for r in labels] == [(1, 2)]


def test_telco(spark, root):
    write(root, "customers.csv",
          "customerID,gender,SeniorCitizen,tenure,Contract,MonthlyCharges,TotalCharges,Churn\n"
          "a,Male,0,2,One year,10, ,Yes\n b ,Female,1,0,Two year,20,5.5,No\n   ,Male,0,1,One year,1,1,No\n"
          "d,,1,3,,20,9,\n")
    adapter = REG.get_dataset("telco")
    events = adapter.events(spark, str(root))
    got = by(events)
    assert set(got) == {"a", "b", "d"}
    assert (got["a"]["total_charges"], got["b"]["total_charges"]) == (0.0, 5.5)
    assert [got[k]["gender_encoded"] for k in "abd"] == [1, 0, -1]
    assert got["a"]["Contract_One year"] == 1.0 and got["d"]["Contract_One year"] == 0.0
    assert (datetime(2019, 1, 31) - got["a"]["event_time"]).days == 60
    labels = {r["customer_id"]: r["lapsed"] for r in adapter.native_labels(events).collect()}
    assert labels == {"a": 1, "b": 0, "d": 0}
    names = adapter.predictors(events).columns
    assert "Churn" not in names and {"engagement_signal", "SeniorCitizen", "Contract_Two year"} <= set(names)


def test_credit_card(spark, root):
    write(root, "cards.csv",
          "CLIENTNUM,Attrition_Flag,Gender,Education_Level,Total_Trans_Amt,Credit_Limit,x1,x2\n"
          "1,Attrited Customer,M,Graduate,100,5,9,9\n2,Existing Customer,F,Unknown,50,7,9,9\n")
    adapter = REG.get_dataset("credit_card")
    events = adapter.events(spark, str(root))
    assert "x1" not in events.columns and "x2" not in events.columns
    got = by(events)
    assert (got[1]["lapsed"], got[2]["lapsed"]) == (1, 0) and got[1]["Gender"] == 1
    assert got[1]["transaction_value"] == 100.0
    assert adapter.predictors(events).columns == [
        "customer_id", "Total_Trans_Amt", "Credit_Limit", "Gender",
        "Education_Level_Graduate", "Education_Level_Unknown"]


def test_lastfm(spark, root):
    n = 60
    pdf = pd.DataFrame({
        "user_id": ["u"] * n + ["v"] * 10,
        "timestamp": [f"2020-01-{1 + i // 2:02d}T{i % 24:02d}:00:00Z" for i in range(n)] + ["2020-01-01T00:00:00Z"] * 10,
        "artist_name": [f"a{i % 7}" for i in range(n)] + ["a"] * 10,
        "track_name": [f"t{i}" for i in range(n)] + ["t"] * 10,
    })
    spark.createDataFrame(pdf).write.parquet(str(root / "lastfm-dataset-1k.snappy.parquet"))
    write(root, "userid-profile.tsv", "u\tm\t20\tGermany\tx\n")
    adapter = REG.get_dataset("lastfm")
    events = adapter.events(spark, str(root))
    assert events.select("customer_id").distinct().count() == 1 and events.first()["country"] == "Germany"
    row = R.listening_table(events).first()
    assert row["total_listens"] == 42 and row["unique_artists"] == 7 and row["days_since_last_listen"] == 0


def test_registry(spark):
    assert len(REG.list_datasets()) == 8
    assert REG.get_ecosystem_type("lastfm") == "music_streaming"
    assert REG.get_ecosystem_type("nothing") == "unknown"
    with pytest.raises(ValueError):
        REG.get_dataset("nothing")
    table = REG.catalogue(spark).collect()
    windows = {r["dataset_name"]: r["window_days"] for r in table}
    assert windows["rees46"] == 90 and windows["telco"] is None and len(table) == 8


def test_readers(spark, root):
    write(root, "a.csv", "x,y\n1,2\n")
    df = RD.read_csv(spark, str(root / "a.csv"), {"y": "int"}, columns=["y"])
    assert df.first()["y"] == 2
    assert RD.read_csv(spark, str(root / "b.csv"), required=False) is None
    report = RD.input_report(spark, [("d", "a", [str(root / "a.csv")]), ("d", "b", [str(root / "b.csv")])])
    assert [r["status"] for r in report.collect()] == ["PASS", "FAIL"]
    import gzip

    with gzip.open(root / "m2.csv.gz", "wt") as f:
        f.write("x,y\n3,4\n")
    write(root, "m1.csv", "x,y\n1,2\n")
    both = RD.read_parts(spark, ["m1.csv", "m2.csv", "m3.csv"], [str(root)], "x int, y int")
    assert both.count() == 2
    with pytest.raises(RD.MissingInput):
        RD.read_parts(spark, ["m9.csv"], [str(root)], "x int")


def test_cleaning_edges(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 100.0)], "k int, v double")
    assert C.fill_median(df.where("v is null"), "v").first()["v"] == 5.0
    capped = {r["k"]: r["v"] for r in C.cap_at_quantile(df, "v", 0.5).collect()}
    assert capped == {1: None, 2: 5.0, 3: 52.5}
    assert C.at_least(df, "v").count() == 2
    with pytest.raises(SchemaError):
        require_columns(df, ["nope"])
    train, test = C.align_columns(df, df.drop("v").withColumn("w", F.lit(1.0)))
    assert train.columns == test.columns == ["k", "v", "w"] and train.first()["w"] == 0.0
    with pytest.raises(ValueError):
        C.category_values(df, "k", 2)
    first = J.keep_first(spark.createDataFrame([(1, None, "a"), (1, 2, "b")], "k int, o int, v string"), ["k"], ["o"])
    assert first.first()["v"] == "b"  # nulls sort last


def test_most_common(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "k int, v string")
    got = {r["k"]: r["v"] for r in J.most_common(df, ["k"], "v").collect()}
    assert got == {1: "a", 2: "unknown"}


def test_parts_bind_by_header(spark, tmp_path):
    from lapse.sources.readers import read_parts

    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z,x\n4,9,3\n")
    (tmp_path / "c.csv").write_text("x\n5\n")
    rows = read_parts(spark, ["a.csv", "b.csv", "c.csv"], [str(tmp_path)], "x int, y int").collect()
    assert sorted((r.x, r.y) for r in rows if r.y) == [(1, 2), (3, 4)] and len(rows) == 3
