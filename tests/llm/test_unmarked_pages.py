"""Pages that mark no article, short pages, and pages where no block is decided."""

import re

import pandas as pd
import pytest

from larder.llm.html_text import main_text

LONG = "The house by the river was the first of the town, and it is still there with the old trees that he had put in. "


def test_a_page_of_short_blocks_stays_whole():
    assert main_text("<body><p>Short note.</p></body>") == "Short note."
    assert main_text("<body><h1>One</h1><p>Two</p><div>Three</div></body>") == "One\nTwo\nThree"


def test_short_blocks_follow_the_nearest_decided_one():
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Section number {i}</a></li>' for i in range(6)) + "</ul>"
    page = f"<body>{menu}<p>Near the menu</p><p>{LONG * 3}</p><p>The end.</p><p>Beside the menu</p>{menu}<p>All of it</p></body>"
    assert main_text(page).split("\n") == ["Near the menu", (LONG * 3).strip(), "The end."]
    assert main_text(f"<body>{menu}<p>Between</p><p>menus</p>{menu}<h2>Title</h2><p>{LONG * 3}</p></body>") == f"Title\n{(LONG * 3).strip()}"


def test_a_little_advert_is_no_article():
    assert main_text('<body><div class="ad">Buy one of these, get another.</div><p>Short note.</p></body>') == "Short note."
    assert main_text('<body><div class="widget"><p>Short note.</p></div></body>') == "Short note."


def test_blocks_of_few_stop_words_without_links_stay_beside_good_ones():
    table = "Copper 12 kilograms, zinc 30 kilograms, tin 7 kilograms, lead 5 kilograms, silver 3 grams"
    assert main_text(f"<body><p>{LONG * 3}</p><p>{table}</p></body>").endswith(table)
    assert main_text(f"<body><p>{table}</p></body>") == table


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_given_pages_lose_nearly_nothing_without_their_marks(scale):
    held = found = 0
    for page in pd.read_parquet(f"/root/testdata/{scale}/pages.parquet").html.dropna():
        whole = main_text(page).split("\n")
        bare = main_text(re.sub(r"</?(?:article|main)\b[^>]*>", "", page)).split("\n")
        assert set(bare) <= {*whole, ""}
        held += sum(map(len, whole))
        found += sum(len(b) for b in bare)
    assert found >= 0.99 * held
