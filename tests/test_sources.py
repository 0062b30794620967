"""A small project from source text to graph, with answers worked out by hand."""

import pytest

from graphloom.operators import graph, resolve
from graphloom.sources import java

SHOP = {
    "src/main/java/shop/api/OrderController.java": """package shop.api;
import shop.order.OrderService; import shop.domain.Order; import java.util.List;
@RestController @RequestMapping("/orders")
public class OrderController {
  private final OrderService service;
  public OrderController(OrderService service) { this.service = service; }
  @GetMapping("/{id}") public Order get(Long id) { return service.load(id); }
  @PostMapping public List<Order> add(Order o) { return service.store(o, 1, 2).stream().toList(); }
}""",
    "src/main/java/shop/order/OrderService.java": """package shop.order;
import shop.domain.*;
public interface OrderService extends Base<Order> { Order load(Long id); Box store(Order o, int... more); }""",
    "src/main/java/shop/order/Base.java": "package shop.order; public interface Base<T> { default void log(T what) { } }",
    "src/main/java/shop/order/OrderServiceImpl.java": """package shop.order;
import shop.domain.Order; import shop.domain.Box; import static shop.order.Checks.check;
@Service class OrderServiceImpl implements OrderService {
  private Box box;
  @Override public Order load(Long id) { check(id); if (id == null && box != null) { return null; } return box.first().copy(); }
  public Box store(Order o, int... more) { log(o); Order kept = new Order(o.name()); this.box.put(kept); return box; }
  public void log(Order what) { switch (more()) { case 1: case 2: break; default: } }
  private int more() { return box == null ? 0 : 1; }
  static class Memo extends Box { Order last() { return super.first(); } }
}""",
    "src/main/java/shop/order/Checks.java": "package shop.order; final class Checks { static void check(Object x) { assert x != null; } }",
    "src/main/java/shop/domain/Order.java": "package shop.domain; @Entity public record Order(String name) { public Order copy() { return new Order(name); } }",
    "src/main/java/shop/domain/Box.java": "package shop.domain; public class Box { private Order top; public Order first() { return top; } void put(Order o) { top = o; } java.util.List<Order> stream() { return null; } }",
    "src/test/java/shop/order/OrderServiceTest.java": "package shop.order; class OrderServiceTest { OrderService s; @Test void works() { s.load(1L); } }",
    "src/main/java/shop/Broken.java": "package shop; class Broken { void f( ",
}


@pytest.fixture(scope="module")
def project(spark):
    files = spark.createDataFrame([(p, "root", t) for p, t in SHOP.items()], "path string, module string, text string")
    entity, edge = resolve.analyse(spark, files)
    return entity.cache(), edge.cache()


def named(project):
    entity, edge = project
    label = {r.id: r.qualified_name.replace("shop.", "") for r in entity.collect()}
    return {(label[r.src], label[r.dst], r.type) for r in edge.collect()}


def test_entities(project):
    rows = {r.qualified_name: r for r in project[0].collect()}
    role = {q.removeprefix("shop."): r.stereotype for q, r in rows.items() if r.stereotype}
    assert role == {"api.OrderController": "CONTROLLER", "order.OrderServiceImpl": "SERVICE", "domain.Order": "ENTITY", "order.OrderServiceTest": "TEST"}
    ends = {(r.http_method, r.http_path) for r in rows.values() if r.kind == "ENDPOINT"}
    assert ends == {("GET", "/orders/{id}"), ("POST", "/orders")}
    assert rows["shop.order.OrderServiceImpl#load(Long)"].complexity == 3 and rows["shop.order.OrderServiceImpl#log(Order)"].complexity == 3
    assert rows["shop.order.OrderServiceImpl#more()"].complexity == 2 and rows["shop.order.OrderServiceImpl"].complexity == 9
    assert "shop.domain.Order#name()" in rows and rows["shop.order.Base"].is_abstract and rows["shop.order.OrderServiceImpl.Memo"].parent_id == rows["shop.order.OrderServiceImpl"].id
    assert rows["shop.order.OrderServiceImpl#store(Order,int[])"].signature == "public Box store(Order, int[])"


def test_edges(project):
    got = named(project)
    impl, api = "order.OrderServiceImpl", "api.OrderController"
    want = {
        ("order.OrderService", "order.Base", "EXTENDS"), (impl, "order.OrderService", "IMPLEMENTS"), ("order.OrderService", "domain.Order", "USES_TYPE"), (f"{impl}.Memo", "domain.Box", "EXTENDS"),
        (api, "order.OrderService", "IMPORTS"), (api, "domain.Order", "IMPORTS"), (impl, "order.Checks", "IMPORTS"),
        (f"{api}#get(Long)", "order.OrderService#load(Long)", "CALLS"), (f"{api}#add(Order)", "order.OrderService#store(Order,int[])", "CALLS"), (f"{api}#add(Order)", "domain.Box#stream()", "CALLS"),
        (f"{impl}#load(Long)", "order.Checks#check(Object)", "CALLS"), (f"{impl}#load(Long)", "domain.Box#first()", "CALLS"), (f"{impl}#load(Long)", "domain.Order#copy()", "CALLS"),
        (f"{impl}#store(Order,int[])", f"{impl}#log(Order)", "CALLS"), (f"{impl}#store(Order,int[])", "domain.Order", "CREATES"), (f"{impl}#store(Order,int[])", "domain.Order#name()", "CALLS"), (f"{impl}#store(Order,int[])", "domain.Box#put(Order)", "CALLS"),
        (f"{impl}#log(Order)", f"{impl}#more()", "CALLS"), (f"{impl}.Memo#last()", "domain.Box#first()", "CALLS"),
        (f"{impl}#load(Long)", "order.OrderService#load(Long)", "OVERRIDES"), (f"{impl}#store(Order,int[])", "order.OrderService#store(Order,int[])", "OVERRIDES"), (f"{impl}#log(Order)", "order.Base#log(T)", "OVERRIDES"),
        (f"{api}#service", "order.OrderService", "USES_TYPE"), ("order.OrderServiceTest#works()", "order.OrderService#load(Long)", "CALLS"),
    }
    assert want <= got, want - got
    assert {x for x in got if x[2] == "ROUTES_TO"} == {(f"endpoint:GET /orders/{{id}}@shop.{api}#get(Long)".replace("shop.", ""), f"{api}#get(Long)", "ROUTES_TO"), (f"endpoint:POST /orders@{api}#add(Order)", f"{api}#add(Order)", "ROUTES_TO")}
    assert not any(a == b for a, b, _ in got)


def test_graph_of_the_project(spark, project):
    entity, edge = project
    ids = {r.qualified_name: r.id for r in entity.collect()}
    seed = spark.createDataFrame([(ids["shop.order.OrderServiceImpl#load(Long)"],)], "id long")
    label = {v: k for k, v in ids.items()}
    up = {label[r.node] for r in graph.bfs(spark, edge, seed, graph.UPSTREAM, 30, True).collect()}
    assert "shop.api.OrderController#get(Long)" in up and any(x.startswith("endpoint:GET") for x in up)
    types = graph.roll_up(entity, edge)
    assert types.where(f"src = {ids['shop.api.OrderController']} and dst = {ids['shop.order.OrderService']}").count() > 0


def test_unreadable_files_say_so():
    rows = java.read("x", SHOP["src/main/java/shop/Broken.java"])
    assert rows[-1]["what"] == "error" and "expected" in rows[-1]["name"]
    assert [r["what"] for r in java.read("y", "")] == ["file"]


def test_uses_beside_calls():
    text = """package p; class A extends B {
  private final Map<String, C> all = new HashMap<String, C>(), more = new D(new E()) { void f() { } };
  int n = 3;
  A(int n) throws F, q.G { super(n, 1); }
  A() { this(3); Object o = (H) get(); if (o == null) return; o = (n) + 1; k(I.class, p.J.class); (o).toString(); for (K k : ks) { } }
}"""
    rows = java.read("x", text)
    assert not [r for r in rows if r["what"] == "error"]
    assert [(r["member"], r["type_text"], r["args"]) for r in rows if r["what"] == "new"] == [("p.A#all", "HashMap<String,C>", 0), ("p.A#more", "D", 1), ("p.A#more", "E", 0)]
    assert [r["type_text"] for r in rows if r["what"] == "use"] == ["F", "q.G", "H", "I", "p.J"]
    assert [(r["name"], r["scope"], r["args"]) for r in rows if r["what"] == "call" and r["name"] == "<init>"] == [("<init>", "super", 2), ("<init>", "this", 1)]
    assert [r["name"] for r in rows if r["what"] == "field"] == ["all", "more", "n"]


def test_type_parameters_stand_for_any_type(spark):
    texts = {
        "p/A.java": "package p; interface A<Key extends Comparable<Key>, V> { void put(Key k, V v); <Other> void swap(Other o); void plain(T t); }",
        "p/B.java": "package p; class B implements A<String, Long> { public void put(String k, Long v) { } public void swap(Integer o) { } public void plain(String t) { } }",
    }
    files = spark.createDataFrame([(p, "root", t) for p, t in texts.items()], "path string, module string, text string")
    entity, edge = resolve.analyse(spark, files)
    name = {r.id: r.qualified_name for r in entity.collect()}
    got = {(name[r.src], name[r.dst]) for r in edge.where("type = 'OVERRIDES'").collect()}
    assert got == {("p.B#put(String,Long)", "p.A#put(Key,V)"), ("p.B#swap(Integer)", "p.A#swap(Other)")}


def test_complexity():
    one = lambda body: next(r for r in java.read("x", f"class A {{ void f(int a) {{ {body} }} }}") if r["what"] == "method")["complexity"]
    assert one("") == 1 and one("if (a > 1 && a < 3 || a == 9) { }") == 4
    assert one("switch (a) { case 1: break; case 2: break; default: } while (a > 0) { }") == 4
    assert one("do { a--; } while (a > 0); int b = a > 1 ? 2 : 3; for (int i : x) { } try { } catch (E e) { }") == 5
