"""A small project in source form, for the queries and tests that read code: {r} is a number that tells copies apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHOP = {
    "src/main/java/r{r}/api/Orders.java": """package r{r}.api;
import r{r}.order.Store;
import r{r}.domain.Order;
@RestController @RequestMapping("/orders")
public class Orders {
  private final Store store;
  public Orders(Store store) { this.store = store; }
  @GetMapping("/{id}") public Order get(Long id) { return store.load(id); }
  @PostMapping public Order add(Order o) { return store.save(o).first(); }
}
""",
    "src/main/java/r{r}/order/Store.java": """package r{r}.order;
import r{r}.domain.*;
public interface Store extends Base<Order> { Order load(Long id); Box save(Order o, int... more); }
""",
    "src/main/java/r{r}/order/Base.java": "package r{r}.order; public interface Base<T> { default void log(T what) { } }",
    "src/main/java/r{r}/order/StoreImpl.java": """package r{r}.order;
import r{r}.domain.Order;
import r{r}.domain.Box;
import static r{r}.order.Checks.check;
@Service class StoreImpl implements Store {
  private Box box;

  @Override public Order load(Long id) { check(id); if (id == null && box != null) { return null; } return box.first().copy(); }
  public Box save(Order o, int... more) { log(o); Order kept = new Order(o.name()); this.box.put(kept); return box; }
  public void log(Order what) { switch (size()) { case 1: case 2: break; default: } }
  private int size() { return box == null ? 0 : 1; }
  static class Memo extends Box { Order last() { return super.first(); } }
}
""",
    "src/main/java/r{r}/order/Checks.java": "package r{r}.order; final class Checks { @Stable static void check(Object x) { while (x == null) { } } }",
    "src/main/java/r{r}/order/Stable.java": "package r{r}.order; @interface Stable { }",
    "src/main/java/r{r}/domain/Order.java": "package r{r}.domain; @Entity public record Order(String name) { public Order copy() { return new Order(name); } }",
    "src/main/java/r{r}/domain/Box.java": "package r{r}.domain; public class Box { private Order top; public Order first() { return top; } void put(Order o) { top = o; } }",
    "src/main/java/r{r}/domain/Rows.java": "package r{r}.domain; interface Rows extends JpaRepository<Order, Long> { enum Way { UP, DOWN; Way back() { return this; } } }",
    "src/test/java/r{r}/order/StoreTest.java": "package r{r}.order; class StoreTest { Store s; @Test void works() { s.load(1L); } }",
}
#: An edit: one file changed, one deleted, one added.
EDITED = {
    "src/main/java/r{r}/domain/Box.java": "package r{r}.domain; public class Box { private Order top; public Order first() { return top; } void put(Order o) { if (o != null) top = o; } int size() { return 1; } }",
    "src/test/java/r{r}/order/StoreTest.java": None,
    "src/main/java/r{r}/domain/Crate.java": "package r{r}.domain; public class Crate extends Box { Box inner() { return new Box(); } }",
}


def files(spark: SparkSession, numbers: DataFrame, texts: dict[str, str | None] = SHOP) -> DataFrame:
    """path, module, sha256, text of a copy of the project for each number n."""
    rows = spark.createDataFrame([(p, t) for p, t in texts.items() if t is not None], "path string, text string")
    fill = lambda c: F.replace(c, F.lit("{r}"), F.col("n").cast("string"))
    some = rows.crossJoin(F.broadcast(numbers.select("n"))).select(fill(F.col("path")).alias("path"), F.lit("root").alias("module"), fill(F.col("text")).alias("text"))  # a row for each file of each copy
    return some.select("path", "module", F.sha2("text", 256).alias("sha256"), "text")
#: Files beside the sources: what marks a module, and what a scan leaves out.
BESIDE = {
    "pom.xml": "<project/>", "tools/build.gradle": "", "tools/src/main/java/t/Tool.java": "package t; class Tool { }", "tools/src/main/java/t/package-info.java": "package t;", "README.md": "# r",
    "target/classes/Gone.java": "class Gone { }", "tools/node_modules/x/Gone.java": "class Gone { }", "src/main/java/Huge.java": "// " + "x" * 1_048_576,
}


def store(spark: SparkSession, root: str, texts: dict[str, str]) -> str:
    """Puts files under a folder that Spark can read."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for path, text in texts.items():
        out = fs.create(jvm.Path(f"{root}/{path}"), True)
        out.write(bytearray(text.encode()))
        out.close()
    return root
