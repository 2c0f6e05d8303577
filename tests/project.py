"""A source tree of a kitchen planner, made up for these tests."""

FILES = {
    "src/hooks/usePantry.ts": """import { useReducer } from 'react';
import axios from 'axios';

const start = { shelves: [] };

export function usePantry() {
  const [stock, dispatch] = useReducer((s, a) => ({ ...s, ...a }), start);
  async function refill(item) {
    await axios.post('/kitchen/stock', { item });
    const fresh = await fetch('/kitchen/stock');
    dispatch(await fresh.json());
  }
  return { stock, refill };
}
""",
    "src/components/RecipeCard.jsx": """import { usePantry } from '../hooks/usePantry';

export const RecipeCard = ({ recipe }) => {
  const { stock, refill } = usePantry();
  const missing = recipe.parts.filter((part) => !stock.shelves.includes(part));
  return <li><b>{recipe.title}</b>{missing.map((part) => <i key={part} onClick={() => refill(part)}>{part}</i>)}</li>;
};
""",
    "src/pages/WeekPlan.tsx": """import { RecipeCard } from '../components/RecipeCard';
import { scalePortions } from '../lib/portions';

export function WeekPlan({ days, guests }) {
  const season = useContext(SeasonContext);
  return <ol>{days.map((day) => <RecipeCard key={day.id} recipe={scalePortions(day.recipe, guests)} season={season} />)}</ol>;
}
""",
    "src/contexts/SeasonContext.ts": """export function SeasonContext() {
  const month = new Date().getMonth();
  return ['winter', 'spring', 'summer', 'autumn'][Math.floor(((month + 1) % 12) / 3)];
}
""",
    "src/Kitchen.tsx": """import { Route, Routes } from 'react-router-dom';
import { WeekPlan } from './pages/WeekPlan';

export function Kitchen() {
  return <Routes><Route path="/week" element={<WeekPlan />} /><Route path="/today" element={<WeekPlan />} /></Routes>;
}
""",
    "src/lib/portions.js": """export function scalePortions(recipe, guests) {
  const factor = guests / recipe.serves;
  const parts = recipe.parts.map((part) => ({ ...part, grams: Math.round(part.grams * factor) }));
  return { ...recipe, serves: guests, parts };
}

export function totalGrams(recipe) {
  let grams = 0;
  for (const part of recipe.parts) { grams += part.grams; }
  return grams > 0 ? grams : recipe.parts.length * 100;
}
""",
    "src/labels.js": """// Words on the kitchen's labels; nothing is declared by a function in this file, so it has no chunk of its own kind.
exports.LABELS = { flour: 'Flour', sugar: 'Sugar', salt: 'Salt', butter: 'Butter', cinnamon: 'Cinnamon' };
""",
    "node_modules/dough/index.js": "module.exports = function dough() {};\n",
}
