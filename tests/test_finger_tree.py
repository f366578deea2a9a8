from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators.finger_tree import FANOUT, FingerTree

steps = st.lists(
    st.one_of(st.tuples(st.just("add"), st.integers(0, 400), st.integers(1, 9)), st.tuples(st.just("evict"), st.integers(0, 400), st.just(0))),
    max_size=600,
)


@settings(max_examples=150, deadline=None)
@given(steps, st.integers(0, 400), st.integers(0, 400))
def test_like_a_dictionary(todo, low, high):
    tree, plain = FingerTree(lambda a, b: a + b, 0), {}
    for what, key, value in todo:
        if what == "add":
            tree.insert(key, value)
            plain[key] = plain.get(key, 0) + value
        else:
            tree.evict(key)
            plain = {k: v for k, v in plain.items() if k >= key}
        assert tree.root.partial == sum(plain.values())
    assert dict(tree.items()) == plain
    assert tree.span(low, high) == sum(v for k, v in plain.items() if low <= k < high)


def test_depth_stays_logarithmic_and_partials_are_not_recounted():
    joined = 0

    def combine(a, b):
        nonlocal joined
        joined += 1
        return a + b

    tree = FingerTree(combine, 0)
    for i in range(20_000):
        tree.insert(i, 1)
    depth, node = 1, tree.root
    while not node.leaf:
        node, depth = node.items[0], depth + 1
    assert depth <= 6
    joined = 0
    tree.insert(5, 1)
    assert joined <= depth * (FANOUT + 1) + 1
    joined = 0
    assert tree.span(0, 20_000) == 20_001
    assert joined <= depth * 4 * FANOUT
